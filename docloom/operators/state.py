"""State that runs along ordered records: budgets, search memory. Batch forms of what ``docloom.streaming`` keeps as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def budget_prefix(df: DataFrame, key: str, order: list[str], amount: str, cap: int) -> DataFrame:
    """Rows of each key, in ``order``, before the first that would exceed ``cap``.

    A running sum decides, because the first rejection stops the run; nothing behind it is accepted even where it would
    fit. Null amounts count as 0; rows with a null key are one run; ``order`` must have no ties. A window sorts each key;
    no key is gathered whole.
    """
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.coalesce(F.col(amount), F.lit(0))).over(run)
    judged = df.withColumn("_over", spent > cap).withColumn("_stopped", F.max("_over").over(run))
    return judged.where(~F.col("_stopped")).drop("_over", "_stopped")


def search_memory(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: int) -> DataFrame:
    """Rows that run: the first of each key, and each that comes ``seconds`` or more after the last that ran.

    Skipped rows are not remembered, so the gap to the previous row does not decide; it is a fold. Rows are hashed by key
    and sorted within partitions, and the fold keeps one time for the key at hand, so a key of any size needs no memory.
    Rows with a null time never run; rows are returned with all their columns; an empty table gives no rows.
    """
    cols = df.columns
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    ready = df.where(F.col(ts).isNotNull()).withColumn("_at", at).repartition(*keys).sortWithinPartitions(*keys, "_at", tie)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last_run = None, 0
        for pdf in batches:
            keep = []
            for key, now in zip(zip(*[pdf[k] for k in keys], strict=True), pdf["_at"], strict=True):
                if key != last_key or now - last_run >= seconds * 1_000_000:
                    last_key, last_run = key, now
                    keep.append(True)
                else:
                    keep.append(False)
            yield pdf.loc[keep, cols]

    return ready.mapInPandas(fold, df.schema)
