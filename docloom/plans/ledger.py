"""Queries on the event ledger: roll-ups, budgets, search memory, state changes. Tasks are event types, sources users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.state import budget_prefix, search_memory
from docloom.tables import table


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with money in whole cents, so that sums do not depend on their order."""
    return table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))


def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("event_type") == "view"
    return ledger(spark, sf_dir).groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("calls"), F.sum("cents").alias("cents"), F.count_if(hit).alias("hits"), F.max("cents").alias("most"), F.count_distinct("user_id").alias("users"))


def ledger_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend of each month so far and what it would be at this rate for the whole month; cost per purchase, null without one."""
    month = F.date_trunc("month", F.col("ts")).cast("date")
    g = ledger(spark, sf_dir).groupBy(month.alias("month")).agg(F.sum("cents").alias("cents"), F.max(F.dayofmonth("ts")).alias("day"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    days = F.dayofmonth(F.last_day("month"))
    return g.select(F.col("month").cast("string").alias("month"), "cents", F.col("day").cast("long").alias("day"), F.floor(F.col("cents") / F.col("day") * days).alias("projected"), F.when(F.col("purchases") > 0, F.floor(F.col("cents") / F.col("purchases"))).alias("per_purchase"))


def ledger_cost_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each user's views and purchases, and per day with a view: conditional sums and distinct counts."""
    view = F.col("event_type") == "view"
    g = ledger(spark, sf_dir).groupBy("user_id").agg(F.sum(F.when(view, F.col("cents")).otherwise(0)).alias("view_cents"), F.sum(F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(0)).alias("purchase_cents"), F.count_distinct(F.when(view, F.to_date("ts"))).alias("view_days"))
    return g.select("*", F.when(F.col("view_days") > 0, F.floor(F.col("view_cents") / F.col("view_days"))).alias("per_day"))


def ledger_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user that fit a cap of 2,000.00: the first that would exceed it stops the user's run."""
    kept = budget_prefix(ledger(spark, sf_dir), "user_id", ["ts", "event_id"], "cents", 200_000)
    return kept.groupBy("user_id").agg(F.count("*").alias("accepted"), F.sum("cents").alias("cents"), F.max("event_id").alias("last_id"))


def ledger_daily_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the spend of one type passed a cap, with the event that passed it."""
    day = Window.partitionBy("event_type", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = ledger(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string")).withColumn("run", F.sum("cents").over(day))
    return run.where("run > 100000").groupBy("event_type", "day").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("rejected"))


def ledger_search_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that run, where the same search is skipped for five days after one that ran (a fold for each key)."""
    events = ledger(spark, sf_dir).select("user_id", "event_type", "ts", "event_id")
    ran = search_memory(events, ["user_id", "event_type"], "ts", "event_id", 5 * 86400)
    return ran.groupBy("user_id", "event_type").agg(F.count("*").alias("ran"), F.min("event_id").alias("first_id"))


def ledger_unseen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose user and type did not occur in the ten days before: an anti join on time, as one window."""
    w = Window.partitionBy("user_id", "event_type").orderBy("t").rangeBetween(-10 * 86400, -1)
    e = ledger(spark, sf_dir).select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("t"))
    return e.withColumn("before", F.count("*").over(w)).where("before = 0").select("event_id", "user_id", "event_type")


def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event of each type."""
    order = F.struct("ts", "event_id")
    return ledger(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by("event_id", order).alias("event_id"), F.max_by("cents", order).alias("cents"))


def ledger_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from one event type to another in each user's history, counted."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = ledger(spark, sf_dir).select("user_id", before.alias("from_type"), F.col("event_type").alias("to_type"))
    return moves.where("from_type IS NULL OR from_type <> to_type").groupBy("from_type", "to_type").agg(F.count("*").alias("n"))


def ledger_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of days without a gain in daily spend, by gaps and islands."""
    days = ledger(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("cents").alias("cents"))
    order = Window.partitionBy("event_type").orderBy("day")
    gain = days.withColumn("gain", F.col("cents") - F.lag("cents").over(order)).where("gain IS NOT NULL")
    marked = gain.withColumn("island", F.sum(F.when(F.col("gain") > 0, 1).otherwise(0)).over(order))
    return marked.where("gain <= 0").groupBy("event_type", "island").agg(F.min("day").alias("first_day"), F.count("*").alias("days")).where("days >= 2").select("event_type", F.col("first_day").cast("string").alias("first_day"), "days")


def ledger_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five events of each user (a log of fixed length)."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return ledger(spark, sf_dir).withColumn("rank", rank).where("rank <= 5").select("user_id", F.col("rank").cast("long").alias("rank"), "event_id")


def ledger_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property read from the events' JSON, averaged by type in tenths."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return ledger(spark, sf_dir).select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


def spend_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star join: revenue in cents by region and market segment; small dimensions are broadcast by their size."""
    li, o, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    j = li.select("l_orderkey", cents.alias("cents")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(n.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(r.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "c_mktsegment").agg(F.sum("cents").alias("cents"), F.count_distinct("l_orderkey").alias("orders"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and prices by return flag and line status."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.sum(cents).alias("cents"), F.count("*").alias("lines"))


def customers_without_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


QUERIES = {
    q.__name__: q
    for q in (
        ledger_rollup, ledger_projection, ledger_cost_per_user, ledger_budget_prefix, ledger_daily_caps, ledger_search_memory, ledger_unseen_pairs, ledger_latest,
        ledger_transitions, ledger_stalled, ledger_last_events, ledger_props, spend_by_segment, pricing_summary, customers_without_large_orders,
    )
}
_E = "(SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
SQL = {
    "ledger_rollup": f"SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, sum(cents)::BIGINT AS cents, count(*) FILTER (WHERE event_type = 'view') AS hits, max(cents) AS most, count(DISTINCT user_id) AS users FROM {_E} GROUP BY ALL",
    "ledger_projection": f"""SELECT CAST(month AS VARCHAR) AS month, cents, day, CAST(floor(cents / day * dayofmonth(last_day(month))) AS BIGINT) AS projected, CASE WHEN p > 0 THEN CAST(floor(cents / p) AS BIGINT) END AS per_purchase FROM (
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, sum(cents)::BIGINT AS cents, max(dayofmonth(ts)) AS day, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM {_E} GROUP BY 1)""",
    "ledger_cost_per_user": f"""SELECT *, CASE WHEN view_days > 0 THEN CAST(floor(view_cents / view_days) AS BIGINT) END AS per_day FROM (SELECT user_id, sum(CASE WHEN event_type = 'view' THEN cents ELSE 0 END)::BIGINT AS view_cents,
sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END)::BIGINT AS purchase_cents, count(DISTINCT CASE WHEN event_type = 'view' THEN CAST(ts AS DATE) END) AS view_days FROM {_E} GROUP BY user_id)""",
    "ledger_budget_prefix": f"""SELECT user_id, count(*) AS accepted, sum(cents)::BIGINT AS cents, max(event_id) AS last_id FROM (SELECT *, max(over_cap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stopped FROM (
SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) > 200000 AS over_cap FROM {_E})) WHERE NOT stopped GROUP BY user_id""",
    "ledger_daily_caps": f"""SELECT event_type, CAST(day AS VARCHAR) AS day, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS rejected FROM (SELECT *, CAST(ts AS DATE) AS day,
sum(cents) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM {_E}) WHERE run > 100000 GROUP BY ALL""",
    "ledger_search_memory": """WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
ran AS (SELECT user_id, event_type, ts, event_id, k, ts AS last_run, TRUE AS runs FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_type, e.ts, e.event_id, e.k, CASE WHEN e.ts >= r.last_run + INTERVAL 5 DAY THEN e.ts ELSE r.last_run END, e.ts >= r.last_run + INTERVAL 5 DAY
FROM ran r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.k = r.k + 1)
SELECT user_id, event_type, count(*) AS ran, min(event_id) AS first_id FROM ran WHERE runs GROUP BY ALL""",
    "ledger_unseen_pairs": """WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)
SELECT event_id, user_id, event_type FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = e.user_id AND x.event_type = e.event_type AND x.t BETWEEN e.t - 864000 AND e.t - 1)""",
    "ledger_latest": f"SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(cents, (ts, event_id)) AS cents FROM {_E} GROUP BY ALL",
    "ledger_transitions": "SELECT from_type, event_type AS to_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_type FROM events) WHERE from_type IS NULL OR from_type <> event_type GROUP BY ALL",
    "ledger_stalled": f"""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(cents)::BIGINT AS cents FROM {_E} GROUP BY ALL), g AS (SELECT *, cents - lag(cents) OVER (PARTITION BY event_type ORDER BY day) AS gain FROM d),
i AS (SELECT *, sum(CASE WHEN gain > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY day) AS island FROM g WHERE gain IS NOT NULL)
SELECT event_type, CAST(min(day) AS VARCHAR) AS first_day, count(*) AS days FROM i WHERE gain <= 0 GROUP BY event_type, island HAVING count(*) >= 2""",
    "ledger_last_events": "SELECT user_id, rank, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5",
    "ledger_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, min(k) AS least, max(k) AS most FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "spend_by_segment": """SELECT r_name, c_mktsegment, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents, count(*) AS lines FROM lineitem GROUP BY ALL",
    "customers_without_large_orders": "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY ALL",
}
