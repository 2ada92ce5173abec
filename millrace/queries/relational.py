"""Scans, projections, filters, aggregations, sorts, sets and functions on users' side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flag_excluded, null_safe_not_equal, optional_filter
from ..operators import aggregates, projections
from ..sources import generate
from ..sources.generate import ACCOUNTS, HOT_PAYMENTS, PAYMENTS, SPAN, draw_sql
from .derived import DIRTY_ORDERS_SQL, dirty_orders
from .registry import query

D = f"WITH d AS ({DIRTY_ORDERS_SQL})"


@query("src04_parquet_scan_pruned", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 400000")
def _(t):
    """Two columns of a pushed-down filter."""
    return t.orders.where("o_totalprice > 400000").select("o_orderkey", "o_orderstatus")


@query("src07_inline_rows", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS v(id, label)")
def _(t):
    return t.spark.createDataFrame([(1, "a"), (2, None)], "id int, label string")


@query("src08_generated_payments", f"""
  SELECT CAST(DATE '2024-02-01' + CAST({draw_sql('day', 0)} % 120 AS INT) AS DATE) AS day, count(*) AS n, CAST(sum({draw_sql('paid', 0)} % 249950 + 50) AS BIGINT) AS cents, count(DISTINCT {draw_sql('account', 0)} % 800) AS accounts
  FROM range(50000) GROUP BY 1""")
def _(t):
    return generate(t.spark, PAYMENTS, 50_000).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("paid") * 100).cast("bigint")).alias("cents"), F.countDistinct("account").alias("accounts"))


@query("src08_generated_accounts", f"SELECT ['basic', 'team', 'scale'][{draw_sql('plan', 0)} % 3 + 1] AS plan, count(*) AS n FROM range(800) GROUP BY 1")
def _(t):
    return generate(t.spark, ACCOUNTS, 800).groupBy("plan").agg(F.count(F.lit(1)).alias("n"))


@query("prj01_standardise", f"{D} SELECT o_orderkey, lower(trim(o_orderpriority)) AS priority, coalesce(o_orderstatus, '?') AS status, o_orderstatus AS raw_o_orderstatus FROM d")
def _(t):
    return projections.standardise(dirty_orders(t), {"o_orderkey": F.col("o_orderkey"), "priority": F.lower(F.trim("o_orderpriority")), "status": F.coalesce("o_orderstatus", F.lit("?"))}, keep_raw=("o_orderstatus",))


@query("prj02_narrow_filter_project", "SELECT l_orderkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DOUBLE) AS saved FROM lineitem WHERE l_quantity >= 45")
def _(t):
    return t.lineitem.where("l_quantity >= 45").select("l_orderkey", (F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("saved"))


@query("prj03_many_columns", "SELECT c_custkey, " + ", ".join(f"c_custkey + {i} AS c{i}" for i in range(40)) + " FROM customer")
def _(t):
    return projections.with_columns(t.customer.select("c_custkey"), {f"c{i}": F.col("c_custkey") + i for i in range(40)})


@query("prj04_explicit_rename", "SELECT c_custkey AS customer_id, c_name AS name FROM customer")
def _(t):
    return projections.rename(t.customer, {"c_custkey": "customer_id", "c_name": "name"}, keep_others=False)


@query("prj05_label_nulls", f"{D} SELECT coalesce(o_orderstatus, 'Unknown') AS o_orderstatus, count(*) AS n FROM d GROUP BY 1")
def _(t):
    return projections.label_nulls(dirty_orders(t), {"o_orderstatus": "Unknown"}).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("flt01_where_keeps_true", f"{D} SELECT count(*) AS n FROM d WHERE o_orderstatus <> 'F'")
def _(t):
    return dirty_orders(t).where("o_orderstatus <> 'F'").agg(F.count(F.lit(1)).alias("n"))


@query("flt02_null_safe_exclusion", f"{D} SELECT count(*) AS n FROM d WHERE o_orderstatus IS DISTINCT FROM 'F'")
def _(t):
    return dirty_orders(t).where(null_safe_not_equal(F.col("o_orderstatus"), "F")).agg(F.count(F.lit(1)).alias("n"))


@query("flt03_case_flag_exclusion", f"{D} SELECT o_orderkey FROM d WHERE CASE WHEN o_orderstatus = 'F' OR amount < 100000 THEN 1 ELSE 0 END = 0")
def _(t):
    return dirty_orders(t).where(flag_excluded(F.col("o_orderstatus") == "F", F.col("amount") < 100000)).select("o_orderkey")


@query("flt04_isin", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("flt07_optional_parameter", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE list_contains(string_split('BUILDING,MACHINERY', ','), c_mktsegment) GROUP BY 1")
def _(t):
    return t.customer.where(optional_filter(F.col("c_mktsegment"), "BUILDING,MACHINERY")).where(optional_filter(F.col("c_name"), "")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("flt08_policies", "SELECT c_custkey, '***' AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    rows = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")
    return projections.apply_policies(rows, {"c_name": "pii", "c_acctbal": "money"}, {"pii": F.lit("***"), "money": F.lit(None)}, F.col("c_custkey").isNotNull())


@query("agg01_hash_aggregate", """
  SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, count(*) AS n
  FROM lineitem GROUP BY 1, 2""")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"), F.count(F.lit(1)).alias("n"))


@query("agg02_03_04_null_aggregates", f"""{D} SELECT count(*) AS n_rows, count(o_orderstatus) AS n_status, CAST(round(avg(CAST(amount AS DOUBLE)), 4) AS DOUBLE) AS mean,
  CAST((SELECT sum(amount) FROM d WHERE false) AS DOUBLE) AS empty_sum, (SELECT count(*) FROM d WHERE false) AS empty_count FROM d""")
def _(t):
    d = dirty_orders(t)
    empty = d.where(F.lit(False)).agg(F.sum("amount").cast("double").alias("empty_sum"), F.count(F.lit(1)).alias("empty_count"))
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count("o_orderstatus").alias("n_status"), F.round(F.avg(F.col("amount").cast("double")), 4).alias("mean")).crossJoin(empty)


@query("agg05_null_groups", f"{D} SELECT o_orderstatus, count(*) AS n, (SELECT count(DISTINCT o_orderstatus) FROM d) AS distinct_statuses FROM d GROUP BY 1")
def _(t):
    d = dirty_orders(t)
    return d.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).crossJoin(d.agg(F.countDistinct("o_orderstatus").alias("distinct_statuses")))


@query("agg06_min_max", "SELECT user_id, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.min("value").alias("least"), F.max("value").alias("most"))


@query("agg07_max_by_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def _(t):
    e = t.events
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("r")).select("user_id", "r.event_type", "r.event_id")


@query("agg08_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t.events.select("user_id", "event_type").distinct()


@query("agg09_conditional_shares", """
  SELECT user_id, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS error_share,
         round(count(*) FILTER (event_type = 'purchase' AND value > 10)::DOUBLE / nullif(count(*) FILTER (event_type = 'purchase'), 0), 6) AS big_purchases
  FROM events GROUP BY 1""")
def _(t):
    bought = F.col("event_type") == "purchase"
    return t.events.groupBy("user_id").agg(F.round(aggregates.share(F.col("event_type") == "error"), 6).alias("error_share"), F.round(aggregates.share(F.col("value") > 10, bought), 6).alias("big_purchases"))


@query("agg10_collect_set", "SELECT user_id, list_sort(list(DISTINCT event_type))::VARCHAR AS types FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("s")).select("user_id", F.concat(F.lit("["), F.array_join("s", ", "), F.lit("]")).alias("types"))


@query("agg11_duplicate_detector", "SELECT count(*) AS total_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def _(t):
    return aggregates.duplicate_count(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("agg12_group_by_all", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def _(t):
    return t.spark.sql("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY ALL", customer=t.customer)


@query("agg13_null_rates", f"{D} SELECT round(avg((o_orderstatus IS NULL)::INT), 6) AS o_orderstatus_null_rate, round(avg((amount IS NULL)::INT), 6) AS amount_null_rate FROM d")
def _(t):
    return aggregates.null_rates(dirty_orders(t), ["o_orderstatus", "amount"]).select(*(F.round(c, 6).alias(c) for c in ("o_orderstatus_null_rate", "amount_null_rate")))


@query("agg14_spend_gaps", f"{D} SELECT o_orderpriority, CAST(sum(amount) AS DOUBLE) AS value, count(*) AS records FROM d WHERE o_orderstatus IS NULL GROUP BY 1")
def _(t):
    return aggregates.gaps(dirty_orders(t), "o_orderstatus", ["o_orderpriority"], "amount").withColumn("value", F.col("value").cast("double"))


@query("agg16_period_durations", "SELECT user_id, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1")
def _(t):
    return aggregates.durations(t.events, ["user_id"], "ts", "ts")


@query("agg17_percent_of_total", """
  SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS value, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(sum(CAST(c_acctbal AS DECIMAL(18,2)))) OVER () AS DOUBLE), 6) AS share
  FROM customer GROUP BY 1""")
def _(t):
    money = t.customer.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    return aggregates.percent_of_total(money, ["c_mktsegment"], "c_acctbal").withColumn("value", F.col("value").cast("double"))


@query("agg_extra_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("agg_extra_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("agg19_skewed_group_by", """
  SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys FROM (SELECT l_suppkey % 10 = 0 AS hot, CASE WHEN l_suppkey % 10 <> 0 THEN 0 ELSE l_suppkey END AS k, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def _(t):
    """Nine tenths of the rows share a key; the partial aggregation leaves one row of it for each task."""
    groups = t.lineitem.groupBy((F.col("l_suppkey") % 10 == 0).alias("hot"), F.when(F.col("l_suppkey") % 10 != 0, F.lit(0)).otherwise(F.col("l_suppkey")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


@query("src08_skewed_generator", f"""
  SELECT CASE WHEN {draw_sql('account/hot', 0)} < {int(0.9 * SPAN)} THEN 0 ELSE {draw_sql('account', 0)} % 800 END = 0 AS hot, count(*) AS n FROM range(400000) GROUP BY 1""")
def _(t):
    """Rows of the hot key and of the others."""
    return generate(t.spark, HOT_PAYMENTS, 400_000).groupBy((F.col("account") == 0).alias("hot")).agg(F.count(F.lit(1)).alias("n"))


@query("srt01_order_by_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("srt02_existence_probe", "SELECT count(*) > 0 AS found FROM (SELECT 1 FROM orders WHERE o_totalprice > 100000 LIMIT 1)")
def _(t):
    return t.orders.where("o_totalprice > 100000").limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("set01_union_by_name", "SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    b = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b)


@query("set02_positional_union", "SELECT c_custkey AS a, c_nationkey AS b FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def _(t):
    """Columns meet by place: right only where both sides list them alike."""
    return t.customer.select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("b")).union(t.supplier.select("s_suppkey", "s_nationkey"))


@query("set04_except_all", "SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select("c_nationkey").exceptAll(t.supplier.select("s_nationkey"))


@query("set05_row_distinctness", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().agg(F.count(F.lit(1)).alias("n"))


@query("set_extra_intersect", "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select("c_nationkey").intersect(t.supplier.select("s_nationkey"))


UPPER = "SELECT c_custkey, upper(c_name) AS name FROM customer"


@F.udf(T.StringType())
def upper_by_row(s):
    return None if s is None else s.upper()


@F.pandas_udf(T.StringType())
def upper_by_batch(s: pd.Series) -> pd.Series:
    return s.str.upper()


@query("udf01_python_udf", UPPER)
def _(t):
    return t.customer.select("c_custkey", upper_by_row("c_name").alias("name"))


@query("udf02_pandas_udf", UPPER)
def _(t):
    return t.customer.select("c_custkey", upper_by_batch("c_name").alias("name"))


@query("udf03_native", UPPER)
def _(t):
    return t.customer.select("c_custkey", F.upper("c_name").alias("name"))


@query("udf05_parametrised_sql", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal >= 5000 GROUP BY 1")
def _(t):
    """Parameters are bound, never pasted into the text."""
    return t.spark.sql("SELECT c_mktsegment, count(*) AS n FROM {customer} WHERE c_acctbal >= :least GROUP BY 1", {"least": 5000}, customer=t.customer)


def null_table(t) -> DataFrame:
    return t.spark.createDataFrame([(1, "A", 10), (2, None, 20), (3, "B", None), (None, "C", 5)], "id int, status string, amount int")


@query("null_semantics_table", """
  WITH t(id, status, amount) AS (VALUES (1, 'A', 10), (2, NULL, 20), (3, 'B', NULL), (NULL, 'C', 5))
  SELECT count(*) FILTER (status <> 'A') AS not_a, count(*) FILTER (status IS DISTINCT FROM 'A') AS null_safe, count(*) AS n_rows, count(status) AS n_status,
         round(avg(amount), 6) AS mean, count(DISTINCT status) AS statuses, (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM t WHERE status = 'C')) AS not_in_null,
         (SELECT count(*) FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.status = 'C' AND b.id = a.id)) AS not_exists, max('a' || status) AS joined, greatest(1, NULL, 2)::INT AS most,
         (SELECT count(*) FROM t a JOIN t b ON a.id = b.id) AS equal_join, (SELECT count(*) FROM t a JOIN t b ON a.id IS NOT DISTINCT FROM b.id) AS null_safe_join
  FROM t""")
def _(t):
    """What NULL does to filters, aggregates, NOT IN, EXISTS, concatenation and joins, in one row."""
    return t.spark.sql("""
      WITH t AS (SELECT * FROM {t})
      SELECT count_if(status <> 'A') AS not_a, count_if(NOT (status <=> 'A')) AS null_safe, count(*) AS n_rows, count(status) AS n_status,
             round(avg(amount), 6) AS mean, count(DISTINCT status) AS statuses, (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM t WHERE status = 'C')) AS not_in_null,
             (SELECT count(*) FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.status = 'C' AND b.id = a.id)) AS not_exists, max(concat('a', status)) AS joined, greatest(1, NULL, 2) AS most,
             (SELECT count(*) FROM t a JOIN t b ON a.id = b.id) AS equal_join, (SELECT count(*) FROM t a JOIN t b ON a.id <=> b.id) AS null_safe_join
      FROM t""", t=null_table(t))
