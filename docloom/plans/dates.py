"""Queries on publication dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.url import host_of
from docloom.operators.timestamps import normalize_timestamps
from docloom.tables import table


def dated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery of a candidate with its publication date in UTC; zone and day order come from the url's site."""
    cands = table(spark, sf_dir, "candidates").select("candidate_id", "publication_date", host_of("url").alias("host"))
    sites = table(spark, sf_dir, "feed_sites").groupBy(F.lower("host").alias("host")).agg(F.min("tz").alias("tz"), F.min("day_first").alias("day_first"))
    return normalize_timestamps(cands.join(sites, "host", "left"), "publication_date", "tz", "day_first", zones=sites)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated_candidates(spark, sf_dir).where("published_utc IS NOT NULL").select("candidate_id", "published_utc").distinct()


def p5_status_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the dates of each site were resolved."""
    return dated_candidates(spark, sf_dir).groupBy("host", F.col("published_utc_status").alias("status")).agg(F.count("*").alias("n"))


QUERIES = {"p5_found": p5_found, "p5_status_by_site": p5_status_by_site}
