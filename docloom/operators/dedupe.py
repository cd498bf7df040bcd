"""Duplicates against earlier records: the first id of each key, found by a window instead of a self join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify_duplicates(df: DataFrame, id_col: str, full_key: str, core_key: str) -> DataFrame:
    """(id, class, matched_id): DUPLICATE of the first record with the same full key, else VARIANT of the first with the
    same non-empty core key, else NEW.

    Only the smallest id of a key matters, so each key is aggregated to one row and joined back: no group is gathered, and
    a key that holds a third of all rows is one row of the smaller side. Null keys match nothing; repeated ids are judged
    alike; an empty table gives no rows.
    """
    full = df.where(F.col(full_key).isNotNull()).groupBy(full_key).agg(F.min(id_col).alias("first_full"))
    core = df.where(F.col(core_key) != "").groupBy(core_key).agg(F.min(id_col).alias("first_core"))
    out = df.join(full, full_key, "left").join(core, core_key, "left")
    dup, var = F.col("first_full") < F.col(id_col), F.col("first_core") < F.col(id_col)
    return out.select(
        F.col(id_col),
        F.when(dup, "DUPLICATE").when(var, "VARIANT").otherwise("NEW").alias("class"),
        F.when(dup, F.col("first_full")).when(var, F.col("first_core")).alias("matched_id"),
    )


def fill_unknown(known: DataFrame, new: DataFrame, key: str, columns: list[str], unknown: str = "UNKNOWN") -> DataFrame:
    """Upsert that fills gaps only: values of ``known`` stay, null, empty or UNKNOWN ones take those of ``new``.

    ``new`` may hold a key several times; the first known value by column order of (column value) is deterministic: the
    smallest. Keys that only one side holds are kept. Columns other than ``key`` and ``columns`` are dropped.
    """
    blank = lambda c: F.when(c.isNull() | (c == "") | (c == unknown), None).otherwise(c)
    fresh = new.groupBy(key).agg(*[F.min(blank(F.col(c))).alias(f"_new_{c}") for c in columns])
    joined = known.select(key, *columns).join(fresh, key, "full")
    return joined.select(key, *[F.coalesce(blank(F.col(c)), F.col(f"_new_{c}"), F.col(c), F.lit(unknown)).alias(c) for c in columns])
