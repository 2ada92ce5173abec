"""Versioned tables, merges, histories and incremental loads; the final state is what is compared."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import history, incremental, quality
from ..table import VersionedTable
from .derived import SEGMENTS_SQL, UPDATES_SQL, first_feed, second_feed, segments
from .registry import query

_local: list[str] = []


def place(t, name: str) -> str:
    """A fresh folder for a table: below the shared folder of the cluster, or a temporary one of a local session."""
    root = t.spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not t.spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="millrace-tables-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = _local[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def loaded(t, **options) -> VersionedTable:
    return VersionedTable.create_from(first_feed(t), place(t, "orders"), key=["o_orderkey"], **options)


MERGED = f"WITH u AS ({UPDATES_SQL}) SELECT o_orderkey, arg_max(status, updated) AS status, max(updated) AS updated FROM u GROUP BY 1"


@query("snk01_append_overwrite", "SELECT o_orderkey, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS updated FROM orders WHERE o_orderkey % 5 = 0")
def _(t):
    table = loaded(t)
    table.overwrite(table.read().where("o_orderkey % 5 = 0"))  # reads the table that it replaces (TBL-04)
    return table.read()


@query("snk03_merge_sequenced", MERGED)
def _(t):
    """Each fifth order changes; half of the changes are older than what is stored and don't count."""
    table = loaded(t)
    table.upsert_sequenced(second_feed(t), ["o_orderkey"], "updated")
    return table.read()


@query("snk04_insert_only_merge", """
  SELECT o_orderkey, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS updated FROM orders
  UNION ALL SELECT o_orderkey + 10000000, 'N', CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 50 = 0""")
def _(t):
    table = loaded(t)
    new = t.orders.where("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.lit("N").alias("status"), F.to_date("o_orderdate").alias("updated"))
    table.merge(first_feed(t).unionByName(new), ["o_orderkey"], insert="*")
    return table.read()


@query("snk06_merge_clauses", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 5 THEN 'was ' || o_orderstatus ELSE o_orderstatus END AS status, CAST(o_orderdate AS DATE) AS updated FROM orders WHERE o_orderkey % 10 <> 0""")
def _(t):
    """Newer changes are noted in the status, older ones delete the row."""
    table = loaded(t)
    table.merge(second_feed(t), ["o_orderkey"], update={"status": "concat('was ', t.status)"}, update_if="s.updated > t.updated", delete_if="s.updated < t.updated")
    return table.read()


@query("snk07_replace_touched_partitions", "SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1")
def _(t):
    """Daily counts; late rows of some days come in a second batch, and only these days are computed again."""
    facts = t.events.select("event_id", F.to_date("ts").alias("d"))
    count = lambda df: df.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    late = (F.dayofmonth("d") % 7 == 0) & (F.col("event_id") % 3 == 0)
    table = VersionedTable.create_from(count(facts.where(~late)), place(t, "daily"), partition_by=["d"])
    incremental.recompute_touched(facts, facts.where(late), table, "d", count)
    return table.read()


@query("snk08_idempotent_token", "SELECT count(*) AS n FROM orders")
def _(t):
    table = VersionedTable.create(t.spark, place(t, "tokens"), "o_orderkey BIGINT, status STRING, updated DATE")
    for _ in range(3):
        table.append(first_feed(t), txn=("loader", 7))
    return table.read().agg(F.count(F.lit(1)).alias("n"))


@query("tbl01_history", "SELECT * FROM (VALUES (CAST(2 AS BIGINT), 'UPSERT'), (1, 'APPEND'), (0, 'CREATE')) AS v(version, operation)")
def _(t):
    table = loaded(t)
    table.upsert_sequenced(second_feed(t), ["o_orderkey"], "updated")
    return table.history().select("version", "operation")


@query("tbl02_src05_time_travel", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    table = loaded(t)
    table.upsert_sequenced(second_feed(t), ["o_orderkey"], "updated")
    return table.read(version=1).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("tbl06_schema_evolution", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'late' END AS note FROM orders")
def _(t):
    table = VersionedTable.create_from(t.orders.where("o_orderkey % 5 <> 0").select("o_orderkey"), place(t, "evolving"))
    table.append(t.orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("late").alias("note")), merge_schema=True)
    return table.read()


@query("tbl08_src14_change_feed", """
  WITH c AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 10 = 5)
  SELECT o_orderkey, o_orderstatus AS status, d AS updated, 'update_preimage' AS change FROM c UNION ALL SELECT o_orderkey, 'X', d + 3, 'update_postimage' FROM c""")
def _(t):
    table = loaded(t)
    table.upsert_sequenced(second_feed(t), ["o_orderkey"], "updated")
    return table.changes(1, 2).withColumnRenamed("_change_type", "change")


@query("tbl09_optimize", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders")
def _(t):
    table = loaded(t)
    table.optimize(4, cluster_by=["updated"])
    table.vacuum()
    return table.read().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"))


@query("inc03_04_watermark_overlap", MERGED)
def _(t):
    """Two runs over a growing source with a lookback of ten years; the merge makes reading twice harmless."""
    table = VersionedTable.create(t.spark, place(t, "target"), "o_orderkey BIGINT, status STRING, updated DATE")
    marks = VersionedTable.create(t.spark, place(t, "marks"), "name STRING, watermark DATE")
    incremental.run_incremental(first_feed(t), table, marks, "orders", ["o_orderkey"], "updated", 0)
    incremental.run_incremental(second_feed(t), table, marks, "orders", ["o_orderkey"], "updated", 10 * 366 * 86400)
    return table.read()


CHANGES = f"WITH s AS ({SEGMENTS_SQL}), c AS (SELECT c_custkey, segment, CAST(valid_from AS TIMESTAMP) AS moment FROM s UNION ALL SELECT c_custkey, segment, CAST(valid_from AS TIMESTAMP) + INTERVAL 100 DAY AS moment FROM s)"
SCD2 = f"""{CHANGES}, h AS (SELECT *, lag(segment) OVER (PARTITION BY c_custkey ORDER BY moment) AS b FROM c), k AS (SELECT c_custkey, segment, moment FROM h WHERE segment IS DISTINCT FROM b)
  SELECT c_custkey, segment, CAST(epoch(moment) AS BIGINT) AS since, CAST(epoch(lead(moment) OVER (PARTITION BY c_custkey ORDER BY moment)) AS BIGINT) AS until FROM k"""


def changes(t):
    s = segments(t).select("c_custkey", "segment", F.col("valid_from").cast("timestamp").alias("at"))
    return s.unionByName(s.withColumn("at", F.col("at") + F.expr("INTERVAL 100 DAYS")))


def shown(df):
    return df.select("c_custkey", "segment", F.unix_timestamp("effective_from").alias("since"), F.unix_timestamp("effective_to").alias("until"))


@query("inc06_scd2_first_load", SCD2)
def _(t):
    return shown(history.build_scd2(changes(t), ["c_custkey"], ["segment"], "at"))


def scd2_table(t):
    c = changes(t)
    table = VersionedTable.create_from(history.build_scd2(c.where("at < '1995-01-01'"), ["c_custkey"], ["segment"], "at"), place(t, "scd2"))
    history.upsert_scd2(table, c.where("at >= '1995-01-01'"), ["c_custkey"], ["segment"], "at")
    history.upsert_scd2(table, c.where("at >= '1995-01-01'"), ["c_custkey"], ["segment"], "at")  # a rerun changes nothing
    return table


@query("inc05_scd2_upsert", SCD2)
def _(t):
    return shown(scd2_table(t).read())


@query("dq13_scd2_invariants", "SELECT * FROM (VALUES ('contiguous', CAST(0 AS BIGINT)), ('no_overlap', 0), ('open_end', 0), ('one_current', 0), ('unique_key', 0)) AS v(rule, violations)")
def _(t):
    table = scd2_table(t).read().withColumn("sk", F.xxhash64("c_custkey", "effective_from"))
    return quality.scd2_violations(table, ["c_custkey"], "sk")


@query("inc08_scd1_dimension", f"WITH s AS ({SEGMENTS_SQL}) SELECT 'C' || c_custkey AS customer_id, arg_max(CASE WHEN c_custkey % 10 = 0 THEN 'Unknown' ELSE segment END, valid_from) AS segment FROM s GROUP BY 1")
def _(t):
    raw = segments(t).select(F.concat(F.lit(" c"), F.col("c_custkey"), F.lit(" ")).alias("customer_id"), F.when(F.col("c_custkey") % 10 == 0, F.lit(" ")).otherwise(F.col("segment")).alias("segment"), "valid_from")
    return history.current_dimension(raw, "customer_id", {"segment": "Unknown"}, [F.desc("valid_from")]).select("customer_id", "segment")


FEED_SQL = f"WITH u AS ({UPDATES_SQL}), f AS (SELECT *, status = 'X' AND o_orderkey % 3 = 0 AS gone FROM u)"


def feed(t):
    return first_feed(t).unionByName(second_feed(t)).withColumn("gone", (F.col("status") == "X") & (F.col("o_orderkey") % 3 == 0))


@query("inc09_auto_cdc_scd1", f"{FEED_SQL} SELECT o_orderkey, updated, status FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY updated DESC) AS rn FROM f) WHERE rn = 1 AND NOT gone")
def _(t):
    return history.apply_cdc(None, feed(t), ["o_orderkey"], "updated", deletes="gone", exclude=["gone"])


@query("inc09_auto_cdc_scd2", f"{FEED_SQL}, c AS (SELECT *, lead(updated) OVER (PARTITION BY o_orderkey ORDER BY updated) AS until FROM f) SELECT o_orderkey, status, updated AS since, until FROM c WHERE NOT gone")
def _(t):
    """Two batches; the second holds changes before those of the first, which are slotted in."""
    f = feed(t)
    first = history.apply_cdc(None, f.where("status <> 'X'"), ["o_orderkey"], "updated", deletes="gone", exclude=["gone"], scd=2)
    both = history.apply_cdc(first, f.where("status = 'X'"), ["o_orderkey"], "updated", deletes="gone", exclude=["gone"], scd=2)
    return both.select("o_orderkey", "status", F.col("__start_at").alias("since"), F.col("__end_at").alias("until"))


@query("inc10_snapshot_changes", """
  SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment || '!' END AS segment, CASE WHEN c_custkey % 7 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 7 = 1""")
def _(t):
    before = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    after = before.where("k % 7 <> 0").withColumn("segment", F.when(F.col("k") % 7 == 1, F.concat("segment", F.lit("!"))).otherwise(F.col("segment")))
    return history.snapshot_changes(before, after, ["k"], F.lit(1)).select("k", "segment", F.col("_op").alias("op"))


@query("inc11_change_points", f"""
  WITH s AS ({SEGMENTS_SQL}), n AS (SELECT c_custkey, c_nationkey AS nation, DATE '1992-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to FROM customer),
       p AS (SELECT c_custkey, valid_from AS changed_at FROM s UNION SELECT c_custkey, valid_from FROM n)
  SELECT p.c_custkey, changed_at, segment, nation FROM p LEFT JOIN s ON s.c_custkey = p.c_custkey AND changed_at >= s.valid_from AND (s.valid_to IS NULL OR changed_at < s.valid_to) LEFT JOIN n ON n.c_custkey = p.c_custkey AND changed_at >= n.valid_from""")
def _(t):
    nations = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.lit("1992-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    out = history.change_points({"s": segments(t), "n": nations}, "c_custkey")
    return out.select("c_custkey", "changed_at", F.col("s_segment").alias("segment"), F.col("n_nation").alias("nation"))


@query("inc12_set03_unknown_member", "SELECT coalesce(n_name, 'Unknown') AS nation, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN 99 ELSE c_nationkey END AS k FROM customer) LEFT JOIN nation ON k = n_nationkey GROUP BY 1")
def _(t):
    dim = history.with_unknown_member(t.nation.select(F.col("n_nationkey").alias("sk"), F.col("n_nationkey").alias("k"), "n_name"), "sk", {"n_name": "Unknown"})
    facts = t.customer.select(F.when(F.col("c_custkey") % 9 == 0, F.lit(99)).otherwise(F.col("c_nationkey")).alias("k"))
    keyed = history.resolve_surrogate(facts, dim.where("sk >= 0"), "k", "sk")
    return keyed.join(dim.select("sk", "n_name"), "sk").groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("inc13_accumulating_snapshot", """
  SELECT user_id, CAST(floor(epoch(min(ts) FILTER (event_type = 'signup'))) AS BIGINT) AS signup, CAST(floor(epoch(min(ts) FILTER (event_type = 'purchase'))) AS BIGINT) - CAST(floor(epoch(min(ts) FILTER (event_type = 'signup'))) AS BIGINT) AS to_purchase FROM events GROUP BY 1""")
def _(t):
    out = history.accumulating_snapshot(t.events, "user_id", "event_type", "ts", ["signup", "purchase"])
    return out.select("user_id", F.unix_timestamp("signup_at").alias("signup"), F.col("signup_to_purchase_seconds").alias("to_purchase"))


@query("inc13_periodic_snapshot", "SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1, 2")
def _(t):
    measures = {"orders": F.count(F.lit(1)), "spent": F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")}
    return history.periodic_snapshot(t.orders, ["o_custkey"], "o_orderdate", "month", measures)


@query("inc13_junk_dimension", """
  SELECT count(*) AS n, f.o_orderstatus, f.o_orderpriority, sha256(coalesce(f.o_orderstatus, '<NULL>') || '||' || coalesce(f.o_orderpriority, '<NULL>')) AS junk_key FROM orders f GROUP BY 2, 3""")
def _(t):
    dim = history.junk_dimension(t.orders, ["o_orderstatus", "o_orderpriority"])
    return t.orders.join(dim, ["o_orderstatus", "o_orderpriority"]).groupBy("o_orderstatus", "o_orderpriority", "junk_key").agg(F.count(F.lit(1)).alias("n"))


@query("inc13_role_playing_nations", """
  SELECT c.n_name AS customer_n_name, s.n_name AS supplier_n_name, count(*) AS n FROM (SELECT DISTINCT c_nationkey, s_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) f
  JOIN nation c ON c.n_nationkey = f.c_nationkey JOIN nation s ON s.n_nationkey = f.s_nationkey GROUP BY 1, 2""")
def _(t):
    """Which nations buy from which: a factless fact with one dimension in two roles."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    fact = history.factless(rows, ["c_nationkey", "s_nationkey"])
    buyer, seller = history.role_view(t.nation, "customer"), history.role_view(t.nation, "supplier")
    out = fact.join(buyer, F.col("c_nationkey") == F.col("customer_n_nationkey")).join(seller, F.col("s_nationkey") == F.col("supplier_n_nationkey"))
    return out.groupBy("customer_n_name", "supplier_n_name").agg(F.count(F.lit(1)).alias("n"))


@query("inc14_lifecycle_inventory", f"WITH u AS ({UPDATES_SQL}) SELECT status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY updated DESC, status) AS rn FROM u) WHERE rn = 1 AND status <> 'X' GROUP BY 1")
def _(t):
    from ..operators.windows import filter_after_rank

    alive = filter_after_rank(first_feed(t).unionByName(second_feed(t)), ["o_orderkey"], [F.desc("updated"), F.col("status")], F.col("status") != "X")
    return alive.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("inc15_backfill_once", "SELECT count(*) AS n FROM orders")
def _(t):
    table = VersionedTable.create(t.spark, place(t, "backfill"), "o_orderkey BIGINT, status STRING, updated DATE")
    for _ in range(2):
        incremental.backfill(table, first_feed(t), "orders")
    return table.read().agg(F.count(F.lit(1)).alias("n"))
