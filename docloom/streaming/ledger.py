"""The event ledger as a stream: daily totals, search memory and budgets as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.tables import scratch_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive as files; times are UTC."""
    stream = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that ``stream`` has now, written to a table in the shared folder by one run of micro-batches, and read again."""
    spark = stream.sparkSession
    at = scratch_path(spark, "streams")
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def settled(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key that ``stream``, an aggregation, gives out in update mode, once all that it has now is read.

    Each micro-batch writes its changed rows under its own number, so that a batch run again replaces its rows, and no
    late row or open window is left out.
    """
    spark = stream.sparkSession
    at = scratch_path(spark, "streams")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    try:
        rows = spark.read.schema(f"{stream.schema.toDDL()}, batch long").option("basePath", f"{at}/rows").parquet(f"{at}/rows")
    except AnalysisException:  # the stream had no file, so no batch ran
        rows = spark.createDataFrame([], f"{stream.schema.toDDL()}, batch long")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def daily_ledger(events: DataFrame) -> DataFrame:
    """Count and cents of each type and day. The state is one row a type and day, so it needs no watermark to stay small."""
    cents = F.round(F.col("value") * 100).cast("long")
    days = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("calls"), F.sum(cents).alias("cents"))
    return days.select("event_type", F.col("window.start").alias("day"), "calls", "cents")


def remembered_searches(events: DataFrame, seconds: int) -> DataFrame:
    """(user_id, event_type, event_id, ts) of the events that run: none within ``seconds`` of the last that ran for the key.

    The state is that one time; within a batch a key's events are folded in the order of their time, so results equal the
    batch operator's as long as batches arrive in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        keep = []
        for at in rows["ts"].astype("int64") // 1000 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].astype("datetime64[us]").astype("int64"):
            runs = last is None or at - last >= seconds * 1_000_000
            last = at if runs else last
            keep.append(runs)
        state.update((int(last),))
        yield pd.DataFrame({"user_id": key[0], "event_type": key[1], "event_id": rows["event_id"], "ts": rows["ts"]})[keep]

    return events.groupBy("user_id", "event_type").applyInPandasWithState(step, "user_id long, event_type string, event_id long, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def budgeted(events: DataFrame, cap: int) -> DataFrame:
    """(user_id, event_id, cents) accepted under a cap for each user; the first rejection stops the user for good."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, stopped = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        keep = []
        for cents in (rows["value"] * 100).round().astype("int64"):
            stopped = stopped or spent + cents > cap
            spent += 0 if stopped else int(cents)
            keep.append(not stopped)
        state.update((spent, bool(stopped)))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "cents": (rows["value"] * 100).round().astype("int64")})[keep]

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, cents long", "spent long, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def paced_hosts(events: DataFrame, spacing_ms: int, errors: int, pause_ms: int) -> DataFrame:
    """(user_id, event_id, start_ms, state): when each request may start, requests of a key at least ``spacing_ms`` apart.

    ``errors`` requests of type 'error' one after another close the key for ``pause_ms``; later ones wait.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, failed = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        clock = rows["ts"].astype("datetime64[us]").astype("int64") // 1000
        for event, now, kind in zip(rows["event_id"], clock.tolist(), rows["event_type"], strict=True):
            start = max(now, free)
            failed = failed + 1 if kind == "error" else 0
            closed = failed >= errors
            free = start + (pause_ms if closed else spacing_ms)
            failed = 0 if closed else failed
            out.append((key[0], event, start, "closed" if closed else "waited" if start > now else "free"))
        state.update((int(free), int(failed)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "start_ms", "state"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, start_ms long, state string", "free long, failed int", "append", GroupStateTimeout.NoTimeout)
