"""Results written for other programs and for people: tables replaced by key, nested packages, bundles, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.web import markdown, safe_name


def replace_by_key(current: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``current`` with all rows of the keys that ``fresh`` holds replaced by those of ``fresh``; columns by name."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def add_once(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``fresh`` whose keys ``current`` lacks, one a key: what an append-only table gains."""
    return fresh.dropDuplicates(keys).join(current.select(*keys).distinct(), keys, "left_anti")


def write_packages(df: DataFrame, path: str, group: str) -> str:
    """One JSON line a row in a folder a group, committed as a whole; gives the schema as JSON."""
    df.write.mode("errorifexists").partitionBy(group).json(path)
    return df.schema.json()


def notes(df: DataFrame, title: str, fields: list[str], marker: str) -> DataFrame:
    """(file, body): a Markdown note a row, all values escaped, unknown ones left out, with a marker that says whose it is."""
    lines = [F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != "") & (F.col(f).cast("string") != "UNKNOWN"), F.concat(F.lit(f"- **{f}**: "), markdown(F.col(f).cast("string")))) for f in fields]
    body = F.concat_ws("\n", F.concat(F.lit("# "), markdown(F.col(title))), F.lit(f"<!-- {marker} -->"), *lines)
    return df.select(F.concat(safe_name(F.col(title)), F.lit(".md")).alias("file"), body.alias("body"))


def write_notes(rows: DataFrame, existing: DataFrame, marker: str) -> DataFrame:
    """(file, body) that may be written: new files, and those whose present body carries the marker.

    ``existing``: file, body. Of several notes for one file the smallest body is kept, so the choice is stable.
    """
    one = rows.groupBy("file").agg(F.min("body").alias("body"))
    foreign = existing.where(~F.col("body").contains(f"<!-- {marker} -->")).select("file")
    return one.join(foreign, "file", "left_anti")
