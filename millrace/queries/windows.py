"""Ranks, sessions, streaks, balances and measures over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates, windows
from .derived import UPDATES_SQL, first_feed, second_feed
from .registry import query


@query("win01_latest_per_key", f"WITH u AS ({UPDATES_SQL}) SELECT o_orderkey, status, updated FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY updated DESC, status) AS rn FROM u) WHERE rn = 1")
def _(t):
    return windows.latest_per_key(first_feed(t).unionByName(second_feed(t)), ["o_orderkey"], [F.desc("updated"), F.col("status")])


@query("win02_rank_within", "SELECT n_regionkey, n_nationkey, n, CAST(rank() OVER (PARTITION BY n_regionkey ORDER BY n DESC) AS INT) AS rank FROM (SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)")
def _(t):
    sizes = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return windows.rank_within(sizes, ["n_regionkey"], [F.desc("n")])


@query("win03_top_n_ties", "SELECT c_nationkey, c_mktsegment, n, rank FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) AS INT) AS rank FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE rank <= 2")
def _(t):
    return windows.top_n(t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")), ["c_nationkey"], [F.desc("n")], 2, ties=True)


@query("win04_top_n_exact", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) WHERE rank <= 2")
def _(t):
    return windows.top_n(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank")


@query("win05_contiguous_intervals", "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key FROM orders")
def _(t):
    return windows.intervals(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "next_key")


@query("win06_collapse_unchanged", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def _(t):
    return windows.collapse_unchanged(t.events.select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")], "event_type")


@query("win07_sessionize", """
  WITH f AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, event_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f""")
def _(t):
    return windows.sessionize(t.events, ["user_id"], "ts", 1800, ["event_id"]).select("user_id", "event_id", "session")


@query("win08_streaks", """
  WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), i AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS g FROM d)
  SELECT user_id, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM i GROUP BY user_id, g""")
def _(t):
    return windows.streaks(t.events.select("user_id", F.to_date("ts").alias("d")), ["user_id"], "d")


@query("win09_partition_aggregate", "SELECT o_orderkey FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS last FROM orders) WHERE o_orderdate = last")
def _(t):
    return t.orders.withColumn("last", F.max("o_orderdate").over(Window.partitionBy("o_custkey"))).where("o_orderdate = last").select("o_orderkey")


@query("win10_running_total", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders")
def _(t):
    money = t.orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return windows.running_total(money, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", F.col("running").cast("double").alias("running"))


@query("win12_population_before_limit", "SELECT o_orderkey, count(*) OVER () AS population FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return windows.top_with_population(t.orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 10).select("o_orderkey", "population")


@query("win13_uptime", """
  WITH e AS (SELECT user_id, ts, event_type FROM events), b AS (SELECT user_id, TIMESTAMP '2024-01-10' AS moment, arg_max(event_type, ts) AS state FROM e WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY 1),
       i AS (SELECT user_id, ts AS moment, event_type AS state FROM e WHERE ts > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'),
       s AS (SELECT *, coalesce(lead(moment) OVER (PARTITION BY user_id ORDER BY moment), TIMESTAMP '2024-01-20') AS nxt FROM (FROM b UNION ALL FROM i))
  SELECT user_id, CAST(sum(CASE WHEN state = 'click' THEN CAST(floor(epoch(nxt)) AS BIGINT) - CAST(floor(epoch(moment)) AS BIGINT) ELSE 0 END) AS BIGINT) AS up_seconds FROM s GROUP BY 1""")
def _(t):
    return windows.uptime(t.events, ["user_id"], "ts", "event_type", "2024-01-10", "2024-01-20", "click")


@query("win14_rank_groups", "SELECT n_regionkey, c_mktsegment, value, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY value DESC, c_mktsegment) AS INT) AS rank FROM (SELECT n_regionkey, c_mktsegment, count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)")
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregates.ranked_groups(rows, ["n_regionkey", "c_mktsegment"], ["n_regionkey"], F.count(F.lit(1)))


DAILY = "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2)"


def daily(t):
    return t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("win16_trailing_7_days", f"{DAILY} SELECT user_id, d, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS last7 FROM d")
def _(t):
    return windows.trailing_days(daily(t), ["user_id"], "d", "n", 7, "last7").select("user_id", "d", "last7")


@query("win16_year_to_date", "WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, d, CAST(sum(n) OVER (PARTITION BY o_custkey, year(d) ORDER BY d) AS BIGINT) AS ytd FROM d")
def _(t):
    rows = t.orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return windows.year_to_date(rows, ["o_custkey"], "d", "n").select("o_custkey", "d", "ytd")


@query("win16_previous_period", "WITH m AS (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1, 2) SELECT *, lag(n) OVER (PARTITION BY o_orderstatus ORDER BY m) AS previous FROM m")
def _(t):
    rows = t.orders.groupBy("o_orderstatus", F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return windows.previous_period(rows, ["o_orderstatus"], "m", "n")


@query("agg15_semi_additive_balance", """
  WITH b AS (SELECT user_id, CAST(ts AS DATE) AS d, arg_max(CAST(value * 100 AS BIGINT), event_id) AS cents FROM events GROUP BY 1, 2)
  SELECT CAST(date_trunc('month', d) AS DATE) AS period, CAST(sum(cents) AS BIGINT) AS value FROM (SELECT *, max(d) OVER (PARTITION BY user_id, date_trunc('month', d)) AS last FROM b) WHERE d = last GROUP BY 1""")
def _(t):
    b = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max_by(F.round(F.col("value") * 100).cast("bigint"), "event_id").alias("cents"))
    return windows.semi_additive(b, ["user_id"], F.to_date(F.date_trunc("month", "d")), "d", "cents")


@query("flt06_rank_then_filter", f"WITH u AS ({UPDATES_SQL}) SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY updated DESC, status) AS rn FROM u) WHERE rn = 1 AND status <> 'X'")
def _(t):
    """Orders whose latest version isn't X; filtering first would bring back the version before."""
    return windows.filter_after_rank(first_feed(t).unionByName(second_feed(t)), ["o_orderkey"], [F.desc("updated"), F.col("status")], F.col("status") != "X").select("o_orderkey")


@query("srt03_top_1_per_group", "SELECT l_partkey, max(l_extendedprice) AS price FROM lineitem GROUP BY 1")
def _(t):
    return windows.top_n(t.lineitem.select("l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber"), ["l_partkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 1).select("l_partkey", F.col("l_extendedprice").alias("price"))


@query("stm_batch_session_windows", """
  WITH f AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
  SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS started, count(*) AS events FROM g GROUP BY user_id, k""")
def _(t):
    """Session windows, in batch."""
    from ..streaming import session_windows

    return session_windows(t.events.select("user_id", "ts"), "ts", ["user_id"]).select("user_id", F.unix_micros("session_start").alias("started"), "events")
