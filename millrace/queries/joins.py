"""Joins and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, windows
from .derived import DIRTY_ORDERS_SQL, PRICES_SQL, SEGMENTS_SQL, dirty_orders, segments
from .registry import query

D = f"WITH d AS ({DIRTY_ORDERS_SQL})"
REGIONS_SQL = """
  LEFT JOIN customer c ON d.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""


def with_region(t, orders):
    """Orders with customer, nation and region; LEFT, so that unknown customers stay, with guarded dimensions."""
    customer = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    region = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    out = joins.safe_left_join(orders, customer, ["o_custkey"])
    out = joins.safe_left_join(joins.safe_left_join(out, nation, ["c_nationkey"]), region, ["n_regionkey"])
    return out.withColumn("region", F.coalesce("region", F.lit("Unknown")))


@query("fct_daily_revenue", f"{D} SELECT o_date, coalesce(r_name, 'Unknown') AS region, CAST(sum(amount) AS DOUBLE) AS revenue, count(*) AS order_count FROM d {REGIONS_SQL} WHERE o_orderstatus IS DISTINCT FROM 'F' GROUP BY 1, 2")
def _(t):
    """JN-03, AGG-01: revenue by day and region; orders of unknown customers are kept, NULL statuses count."""
    orders = dirty_orders(t).where(~F.col("o_orderstatus").eqNullSafe("F"))
    return with_region(t, orders).groupBy("o_date", "region").agg(F.sum("amount").cast("double").alias("revenue"), F.count(F.lit(1)).alias("order_count"))


@query("top_customers_per_region", f"""{D}, s AS (SELECT coalesce(r_name, 'Unknown') AS region, d.o_custkey, CAST(sum(amount) AS DOUBLE) AS revenue FROM d {REGIONS_SQL} GROUP BY 1, 2)
  SELECT * FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY region ORDER BY revenue DESC) AS INT) AS rank FROM s WHERE revenue IS NOT NULL) WHERE rank <= 3""")
def _(t):
    totals = with_region(t, dirty_orders(t)).groupBy("region", "o_custkey").agg(F.sum("amount").cast("double").alias("revenue")).where("revenue IS NOT NULL")
    return windows.top_n(totals, ["region"], [F.desc("revenue")], 3, ties=True)


SALES = "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


@query("jn01_broadcast_join", SALES)
def _(t):
    """Catalyst broadcasts the customers while they are under the threshold."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("jn02_sort_merge_join", SALES)
def _(t):
    return t.orders.join(t.customer.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("jn04_lookup_fail_loud", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS label FROM orders")
def _(t):
    return joins.lookup(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "filled", "O": "open", "P": "partial"}, "label", "string").drop("o_orderstatus")


@query("jn05_fanout_count", "SELECT count(*) AS joined_rows FROM orders LEFT JOIN nation ON o_custkey % 25 = n_nationkey")
def _(t):
    orders = t.orders.select((F.col("o_custkey") % 25).cast("int").alias("n_nationkey"))
    out = orders.join(t.nation, "n_nationkey", "left")
    joins.assert_same_row_count(orders, out, "orders to nations")
    return out.agg(F.count(F.lit(1)).alias("joined_rows"))


@query("jn06_safe_left_join", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    return joins.safe_left_join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"]).drop("c_custkey")


@query("jn07_many_to_many", "SELECT c_nationkey, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
def _(t):
    return t.customer.join(t.supplier, F.col("c_nationkey") == F.col("s_nationkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("jn08_dedupe_then_join", f"""
  WITH s AS ({SEGMENTS_SQL}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY valid_from DESC) AS rn FROM s) WHERE rn = 1)
  SELECT o_orderkey, segment FROM orders LEFT JOIN l ON o_custkey = c_custkey""")
def _(t):
    dim = joins.latest_dimension(segments(t), ["c_custkey"], [F.desc("valid_from")])
    return t.orders.join(dim, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "segment")


PIT = f"WITH s AS ({SEGMENTS_SQL}), o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)"


@query("jn09_point_in_time_join", f"{PIT} SELECT o_orderkey, segment FROM o LEFT JOIN s ON o_custkey = c_custkey AND d >= valid_from AND (valid_to IS NULL OR d < valid_to)")
def _(t):
    facts = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("d"))
    return joins.point_in_time_join(facts, segments(t), ["c_custkey"], "d").select("o_orderkey", "segment")


def prices(t):
    days = t.spark.sql("SELECT * FROM VALUES (DATE '1995-01-01', DATE '1997-01-01', CAST(1.00 AS DECIMAL(4,2))), (DATE '1997-01-01', DATE '1999-01-01', CAST(1.10 AS DECIMAL(4,2))), (DATE '1999-01-01', NULL, CAST(1.25 AS DECIMAL(4,2))) AS d(price_from, price_to, factor)")
    brands = t.part.groupBy("p_brand").agg((F.sum(F.col("p_retailprice").cast("decimal(18,2)")) / F.count(F.lit(1))).cast("decimal(18,2)").alias("avg_price"))
    return brands.crossJoin(F.broadcast(days)).select("p_brand", "price_from", "price_to", (F.col("avg_price") * F.col("factor")).cast("decimal(18,4)").alias("price"))


#: Usage of parts: some days from shipping on; a twentieth is older than any price.
USAGE_SQL = """
  SELECT l_orderkey * 100 + l_linenumber AS record, p_brand, CASE WHEN l_orderkey % 20 = 0 THEN DATE '1994-06-01' ELSE CAST(l_shipdate AS DATE) END AS used_from,
         CASE WHEN l_orderkey % 20 = 0 THEN DATE '1994-06-05' ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) END AS used_to, CAST(l_quantity AS BIGINT) AS quantity
  FROM (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS l_shipdate, min(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey"""


def usage(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate"), F.min("l_quantity").alias("l_quantity"), F.min("l_partkey").alias("p_partkey"))
    old, day = F.col("l_orderkey") % 20 == 0, F.to_date("l_shipdate")
    return lines.join(t.part.select("p_partkey", "p_brand"), "p_partkey").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("record"), "p_brand", F.when(old, F.lit("1994-06-01").cast("date")).otherwise(day).alias("used_from"),
        F.when(old, F.lit("1994-06-05").cast("date")).otherwise(F.date_add(day, F.col("l_quantity").cast("int"))).alias("used_to"), F.col("l_quantity").cast("bigint").alias("quantity"))


PRICED = f"WITH u AS ({USAGE_SQL}), p AS ({PRICES_SQL})"


@query("jn10_containment_price", f"{PRICED} SELECT count(*) AS n, CAST(sum(quantity * price) AS DOUBLE) AS cost FROM u JOIN p ON u.p_brand = p.p_brand AND used_from >= price_from AND (price_to IS NULL OR used_to <= price_to)")
def _(t):
    out = joins.containment_join(usage(t), prices(t), ["p_brand"], "used_from", "used_to", "price_from", "price_to")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quantity") * F.col("price")).cast("double").alias("cost"))


@query("jn11_price_coverage", f"""{PRICED}, j AS (SELECT u.*, price FROM u LEFT JOIN p ON u.p_brand = p.p_brand AND used_to >= price_from AND (price_to IS NULL OR used_to < price_to))
  SELECT count(price) AS priced_rows, count(*) - count(DISTINCT record) AS duplicate_matches, count(DISTINCT CASE WHEN price IS NULL THEN record END) AS unpriced_records FROM j""")
def _(t):
    return joins.coverage(joins.point_in_time_join(usage(t), prices(t), ["p_brand"], "used_to", "price_from", "price_to"), "record", "price")


@query("dq16_coverage_beside_sums", f"""{PRICED}, j AS (SELECT u.*, price FROM u LEFT JOIN p ON u.p_brand = p.p_brand AND used_to >= price_from AND (price_to IS NULL OR used_to < price_to))
  SELECT p_brand, CAST(sum(quantity * price) AS DOUBLE) AS cost, count(price) AS priced, count(*) FILTER (price IS NULL) AS unpriced FROM j GROUP BY 1""")
def _(t):
    out = joins.point_in_time_join(usage(t), prices(t), ["p_brand"], "used_to", "price_from", "price_to")
    return out.groupBy("p_brand").agg(F.sum(F.col("quantity") * F.col("price")).cast("double").alias("cost"), F.count("price").alias("priced"), F.count_if(F.col("price").isNull()).alias("unpriced"))


ASOF = """
  WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id AS view_id FROM events WHERE event_type = 'view')
  SELECT p.event_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"""


def last_view(t, **options):
    e = t.events.select("user_id", "ts", "event_id", "event_type")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("viewed"), F.col("event_id").alias("view_id"))
    bought = e.where("event_type = 'purchase'").drop("event_type")
    return joins.asof_join(bought, views, ["user_id"], "ts", "viewed", ["view_id"], **options).select("event_id", "view_id")


@query("jn12_asof_join", ASOF)
def _(t):
    """The last view before each purchase of a user."""
    return last_view(t)


@query("jn12_asof_join_in_buckets", ASOF)
def _(t):
    """The same, with each user's rows dealt by days."""
    return last_view(t, bucket_seconds=86_400)


@query("jn13_null_safe_join", f"{D}, s AS (SELECT * FROM (VALUES ('F', 1), ('O', 2), (NULL, 3)) AS v(o_orderstatus, code)) SELECT code, count(*) AS n FROM d JOIN s ON d.o_orderstatus IS NOT DISTINCT FROM s.o_orderstatus GROUP BY 1")
def _(t):
    codes = t.spark.createDataFrame([("F", 1), ("O", 2), (None, 3)], "o_orderstatus string, code int")
    return joins.null_safe_join(dirty_orders(t), codes, "o_orderstatus").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("jn14_anti_join_orphans", f"{D} SELECT o_orderkey FROM d WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")
def _(t):
    return dirty_orders(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("jn14_not_in_with_null", f"{D} SELECT count(*) AS n FROM customer WHERE c_mktsegment NOT IN (SELECT o_orderstatus FROM d)")
def _(t):
    return t.spark.sql("SELECT count(*) AS n FROM {c} WHERE c_mktsegment NOT IN (SELECT o_orderstatus FROM {d})", c=t.customer, d=dirty_orders(t))


@query("jn15_salted_join", "SELECT p_brand, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(t):
    lines = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_quantity")
    return joins.salted_join(lines, t.part.select("p_partkey", "p_brand"), ["p_partkey"]).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("jn16_skew_join", "SELECT c_mktsegment, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 < 9 THEN 1 ELSE o_custkey END AS k FROM orders) JOIN customer ON k = c_custkey GROUP BY 1")
def _(t):
    """Nine tenths of the orders share a customer; both sides are shuffled, and AQE splits the hot partition where it is large."""
    hot = t.orders.select(F.when(F.col("o_orderkey") % 10 < 9, F.lit(1)).otherwise(F.col("o_custkey")).alias("k"))
    return hot.join(t.customer.hint("merge"), F.col("k") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("jn17_canonical_key_join", "SELECT count(*) AS n FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS k FROM orders) JOIN customer ON CAST(k AS BIGINT) = c_custkey")
def _(t):
    """Text keys are brought to the other side's type before the join, so that a bad key is NULL, not an error."""
    text = t.orders.select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("k"))
    return text.select(F.col("k").try_cast("bigint").alias("k")).join(t.customer, F.col("k") == F.col("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("jn18_19_declared_join", "SELECT o.o_orderkey AS orders_o_orderkey, c.c_name AS customer_c_name, n.n_name AS nation_n_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey")
def _(t):
    steps = [joins.JoinStep("customer", {"c_custkey": "orders_o_custkey"}), joins.JoinStep("nation", {"n_nationkey": "customer_c_nationkey"}, "inner")]
    return joins.declared_join({"orders": t.orders, "customer": t.customer, "nation": t.nation}, "orders", steps).select("orders_o_orderkey", "customer_c_name", "nation_n_name")


SPANS = "WITH s AS (SELECT user_id, event_type, min(ts) AS started, max(ts) AS ended FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id, event_type, CAST(ts AS DATE))"


@query("jn20_interval_overlap", f"{SPANS} SELECT a.user_id, count(*) AS overlaps FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.started < b.ended AND b.started < a.ended GROUP BY 1")
def _(t):
    days = t.events.where("event_type IN ('click', 'purchase')").groupBy("user_id", "event_type", F.to_date("ts").alias("d")).agg(F.min("ts").cast("timestamp").alias("started"), F.max("ts").cast("timestamp").alias("ended"))
    one = lambda kind: days.where(F.col("event_type") == kind).select("user_id", "started", "ended")
    return joins.overlap_join(one("click"), one("purchase"), ["user_id"], "started", "ended", bucket_seconds=86_400).groupBy("user_id").agg(F.count(F.lit(1)).alias("overlaps"))


@query("jn21_self_join", "SELECT a.n_regionkey, count(*) AS pairs FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY 1")
def _(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).groupBy(F.col("a.n_regionkey")).agg(F.count(F.lit(1)).alias("pairs"))


@query("jn_range_join_cells", """
  WITH r(low, high, band) AS (VALUES (0, 50000, 'a'), (50000, 200000, 'b'), (200000, 1000000, 'c'))
  SELECT band, count(*) AS n FROM orders JOIN r ON CAST(floor(o_totalprice) AS BIGINT) >= low AND CAST(floor(o_totalprice) AS BIGINT) < high GROUP BY 1""")
def _(t):
    bands = t.spark.createDataFrame([(0, 50000, "a"), (50000, 200000, "b"), (200000, 1000000, "c")], "low bigint, high bigint, band string")
    return joins.range_join(t.orders.select(F.floor("o_totalprice").alias("price")), bands, "price", "low", "high", 50_000).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
