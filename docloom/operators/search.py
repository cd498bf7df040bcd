"""Searches over titles, follow-up queries, ranking of what to read, caches of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import STOP_WORDS
from docloom.functions.web import query_key


def query_words(query, shortest: int = 3):
    """Distinct words of a query of ``shortest`` letters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(*STOP_WORDS)))


def title_search(items: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` items of each query: (query, item_id, hits), at least two of its words in the title, or its one.

    ``items``: item_id, title; ``queries``: query. Words join words, so only items that share one are looked at; a
    frequent word costs its items, never all pairs. Ties go to the smaller item_id; null titles match nothing.
    """
    words = items.select("item_id", F.explode(query_words(F.col("title"))).alias("word"))
    asked = queries.select("query").distinct().withColumn("words", query_words(F.col("query")))
    wanted = asked.select("query", F.size("words").alias("n"), F.explode("words").alias("word"))
    hits = words.join(wanted, "word").groupBy("query", "n", "item_id").agg(F.count_distinct("word").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("hits"), "item_id"))
    return hits.where(F.col("hits") >= F.least(F.lit(2), F.col("n"))).withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "item_id", "hits")


def follow_up_queries(families: DataFrame, templates: list[str], asked: DataFrame, limit: int) -> DataFrame:
    """(query, rank): templates filled with families by falling count, first seen first among equals, without those asked.

    ``families``: family, n, first_seen; ``asked``: query. The templates are a list given as a parameter.
    """
    order = F.row_number().over(Window.orderBy(F.desc("n"), "first_seen", "family"))
    best = families.orderBy(F.desc("n"), "first_seen", "family").limit(limit).withColumn("place", order)
    made = best.select("place", "family", F.posexplode(F.array(*map(F.lit, templates))).alias("t", "template"))
    made = made.withColumn("query", F.replace("template", F.lit("{}"), F.lower("family"))).withColumn("key", query_key(F.col("query")))
    first = made.groupBy("key").agg(F.min_by("query", F.struct("place", "t")).alias("query"), F.min(F.struct("place", "t")).alias("at"))
    fresh = first.join(asked.select(query_key(F.col("query")).alias("key")).distinct(), "key", "left_anti")
    return fresh.orderBy("at").limit(limit).select("query", F.row_number().over(Window.orderBy("at")).alias("rank"))


def reading_order(sources: DataFrame, refused_hosts: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` sources to read first: hosts that refused last, free ones before others, then relevance, tier, id.

    ``sources``: source_id, host, free, relevance, tier; ``refused_hosts``: host.
    """
    marked = sources.join(refused_hosts.select("host", F.lit(True).alias("refused")).distinct(), "host", "left")
    access = F.when(F.col("refused"), 2).when(F.col("free"), 0).otherwise(1)
    return marked.withColumn("access", access).orderBy("access", F.desc("relevance"), F.coalesce("tier", F.lit(9)), "source_id").limit(limit).select("source_id", F.col("access").cast("long").alias("access"), "relevance", "tier")


def with_cache(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the cached answer of their key and what they still cost: nothing on a hit.

    ``asked``: key, cost; ``cache``: key, answer, truncated; truncated answers are never used, and the latest key wins no
    tie because keys are unique in a cache.
    """
    usable = cache.where("NOT truncated").groupBy("key").agg(F.first("answer").alias("answer"))
    return asked.join(usable, "key", "left").select("key", "answer", F.col("answer").isNotNull().alias("hit"), F.when(F.col("answer").isNotNull(), 0).otherwise(F.col("cost")).alias("cost"))
