"""Streams that run to their end; results that don't depend on batches are checked by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as S
from ..operators.documents import backlinks, broken_links, links, search, sections
from ..plans.metrics import metric_view
from ..plans.spec import run as run_spec
from ..sources.files import parse_rescued, reconcile_rescued
from ..table import VersionedTable
from .changes import place
from .derived import DIRTY_ORDERS_SQL, dirty_orders
from .registry import query


def stream(t, name: str):
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


@query("stm01_02_passthrough", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(t):
    """Two runs over one checkpoint write each row once."""
    base = place(t, "stream")
    for _ in range(2):
        S.run_available_now(stream(t, "events"), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("stm03_tumbling_windows", """
  SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, count(*) AS events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def _(t):
    """Hourly sums kept up to date by merges: update mode through foreachBatch (SNK-09, STM-10)."""
    cents = stream(t, "events").select("ts", F.round(F.col("value") * 100).cast("bigint").alias("value"))
    sums = S.windowed_sum(cents, "ts", "value", "1 hour", "10 minutes").select(F.unix_timestamp("window_start").alias("start"), "events", "total")
    base = place(t, "windows")
    table = VersionedTable.create(t.spark, f"{base}/table", "start BIGINT, events BIGINT, total BIGINT")
    S.sink_table(sums, table, f"{base}/checkpoint", "hourly", keys=["start"])
    return table.read()


@query("stm06_enrich_per_batch", "SELECT user_id % 3 AS tier, count(*) AS n FROM events GROUP BY 1")
def _(t):
    base = place(t, "enrich")
    dim = VersionedTable.create_from(t.events.select("user_id").distinct().withColumn("tier", F.col("user_id") % 3), f"{base}/dim")
    out = VersionedTable.create(t.spark, f"{base}/out", "user_id BIGINT, event_id BIGINT, tier BIGINT")
    S.enrich_per_batch(stream(t, "events").select("user_id", "event_id"), dim.read_latest(), ["user_id"], out, f"{base}/checkpoint", "enrich")
    return out.read().groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("stm09_dedupe_within_watermark", "SELECT count(*) AS n FROM events")
def _(t):
    """Each event comes twice; one of both stays."""
    base = place(t, "dedupe")
    e = stream(t, "events").select("event_id", "ts")
    twice = e.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    S.run_available_now(S.dedupe_within_watermark(twice, ["event_id"], "ts", "100 days").select("event_id"), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("n"))


@query("stm11_time_bounded_join", """
  SELECT count(*) AS n FROM (SELECT user_id, ts FROM events WHERE event_type = 'view') a JOIN (SELECT user_id AS u, ts AS bought FROM events WHERE event_type = 'purchase') b ON user_id = u AND bought >= ts AND bought <= ts + INTERVAL 1 HOUR""")
def _(t):
    base = place(t, "join")
    views = stream(t, "events").where("event_type = 'view'").select("user_id", "ts")
    bought = stream(t, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"))
    S.run_available_now(S.stream_join(views, bought, "user_id", "ts", "bought", "1 HOUR", "2 hours").select("a.user_id", "b.bought"), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("n"))


@query("stm12_13_fan_in", "SELECT kind, count(*) AS n FROM (SELECT 'events' AS kind FROM events UNION ALL SELECT 'orders' FROM orders) GROUP BY 1")
def _(t):
    base = place(t, "fan-in")
    table = VersionedTable.create(t.spark, f"{base}/table", "kind STRING, id BIGINT")
    a = stream(t, "events").select(F.lit("events").alias("kind"), F.col("event_id").alias("id"))
    b = stream(t, "orders").select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id"))
    S.fan_in({"events": a, "orders": b}, table, base)
    return table.read().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("src11_15_rescued_columns", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def _(t):
    """A key that the schema lacks is rescued as JSON and read again once the schema has it."""
    lines = t.customer.select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))).alias("value"))
    return reconcile_rescued(parse_rescued(lines, "value", "id BIGINT"), "segment STRING").select("id", "segment")


def markdown(t):
    """Part names as small Markdown pages that link to each other."""
    name = F.concat(F.lit("# "), F.col("p_name"), F.lit("\n"), F.col("p_brand"), F.lit(" see [next](p"), (F.col("p_partkey") + 1).cast("string"), F.lit("#top)\n## Type\n"), F.col("p_type"), F.lit(" "), F.col("p_type"))
    return t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("page"), name.alias("body"))


@query("doc02_sections", "SELECT 'p' || p_partkey AS page, 1 AS level, p_name AS heading, round((len(string_split(p_brand, ' ')) + 2) / 220.0, 4)::DOUBLE AS minutes FROM part UNION ALL SELECT 'p' || p_partkey, 2, 'Type', round(len(string_split(p_type, ' ')) * 2 / 220.0, 4)::DOUBLE FROM part")
def _(t):
    return sections(markdown(t), "page", "body").select("page", "level", "heading", "minutes")


@query("doc03_backlinks", "SELECT 'p' || (p_partkey + 1) AS page, 'p' || p_partkey AS backlinks FROM part")
def _(t):
    return backlinks(links(markdown(t), "page", "body")).select("page", F.array_join("backlinks", ",").alias("backlinks"))


@query("doc05_broken_links", "SELECT 'p' || max(p_partkey) AS source FROM part")
def _(t):
    anchors = markdown(t).select("page", F.lit("top").alias("anchor"))
    return broken_links(links(markdown(t), "page", "body"), anchors).select("source")


@query("doc04_search", """
  WITH d AS (SELECT doc_id, source, lower(text) AS b FROM documents), f AS (
    SELECT doc_id, source, CAST((length(b) - length(replace(b, 'the', ''))) / 3 + (length(b) - length(replace(b, 'of', ''))) / 2 AS INT) AS score FROM d WHERE contains(b, 'the') AND contains(b, 'of')),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM f)
  SELECT doc_id, source, score FROM r WHERE rn <= 3 ORDER BY score DESC, source, doc_id LIMIT 30""")
def _(t):
    entries = t.documents.select("doc_id", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("heading"), F.lit("").alias("title"), F.col("text").alias("body"))
    return search(entries, "The of", page="source").select("doc_id", "source", "score")


@query("dsl01_pipeline_spec", f"WITH d AS ({DIRTY_ORDERS_SQL}) SELECT c_mktsegment AS segment, count(*) AS n FROM d LEFT JOIN customer ON o_custkey = c_custkey WHERE coalesce(o_orderstatus IN ('F', 'O', 'P'), false) GROUP BY 1")
def _(t):
    spec = {
        "tokens": {"statuses": "'F', 'O', 'P'"},
        "templates": {"checked": {"rules": {"known": "o_orderstatus IN (${statuses})"}, "quarantine": "table"}},
        "nodes": [
            {"name": "enriched", "sources": [{"table": "clean"}, {"table": "customer", "on": {"c_custkey": "clean_o_custkey"}}], "select": {"segment": "customer_c_mktsegment"}},
            {"name": "clean", "sources": [{"table": "orders"}], "template": "checked"},
        ],
    }
    return run_spec(spec, {"orders": dirty_orders(t), "customer": t.customer})["enriched"].groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("dsl03_metric_view", """
  SELECT c_mktsegment AS segment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS orders, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS average
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def _(t):
    spec = {
        "source": "orders", "joins": [{"source": "customer", "on": {"c_custkey": "orders_o_custkey"}}], "dimensions": {"segment": "customer_c_mktsegment"},
        "measures": {"revenue": "cast(sum(cast(orders_o_totalprice as decimal(18,2))) as double)", "orders": "count(1)", "average": "round(MEASURE(revenue) / MEASURE(orders), 4)"},
    }
    return metric_view(spec, {"orders": t.orders, "customer": t.customer}, ["segment"], ["revenue", "orders", "average"])
