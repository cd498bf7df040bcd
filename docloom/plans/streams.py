"""Queries that drain the event stream; their SQL states what the batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.streaming.ledger import budgeted, daily_ledger, drained, event_stream, paced_hosts, remembered_searches, settled


def stream_daily_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's totals once the stream has been read to its end."""
    days = settled(daily_ledger(event_stream(spark, sf_dir)), ["event_type", "day"])
    return days.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "calls", "cents")


def stream_search_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = drained(remembered_searches(event_stream(spark, sf_dir), 5 * 86400))
    return ran.groupBy("user_id", "event_type").agg(F.count("*").alias("ran"), F.min("event_id").alias("first_id"))


def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drained(budgeted(event_stream(spark, sf_dir), 200_000))
    return kept.groupBy("user_id").agg(F.count("*").alias("accepted"), F.sum("cents").alias("cents"), F.max("event_id").alias("last_id"))


def stream_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user at least ten minutes apart, closed for half an hour after two errors one after another."""
    return drained(paced_hosts(event_stream(spark, sf_dir), 600_000, 2, 1_800_000))


QUERIES = {q.__name__: q for q in (stream_daily_ledger, stream_search_memory, stream_budget, stream_paced)}
from docloom.plans.ledger import SQL as _BATCH  # noqa: E402

SQL = {
    "stream_search_memory": _BATCH["ledger_search_memory"],
    "stream_budget": _BATCH["ledger_budget_prefix"],
    "stream_daily_ledger": "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL",
    "stream_paced": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' AS bad, epoch_us(ts) // 1000 AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, event_id, now AS start_ms, 'free' AS state, k, now + 600000 AS free, CASE WHEN bad THEN 1 ELSE 0 END AS failed FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, greatest(e.now, s.free),
  CASE WHEN e.bad AND s.failed = 1 THEN 'closed' WHEN s.free > e.now THEN 'waited' ELSE 'free' END, e.k,
  greatest(e.now, s.free) + CASE WHEN e.bad AND s.failed = 1 THEN 1800000 ELSE 600000 END,
  CASE WHEN e.bad AND s.failed = 0 THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, event_id, start_ms, state FROM s""",
}
