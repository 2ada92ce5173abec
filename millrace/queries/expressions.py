"""Parsers, keys, hashes and time zones over derived text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    canonical_uuid, day_hours, fixed_offset_time, local_date, map_vocabulary, normalize_customer_id, parse_amount, parse_failed, parse_timestamp, query_fingerprint, region_from_sku, row_hash, slug, to_utc, would_round,
)
from ..operators import projections
from .registry import query


@query("str01_parse_timestamp", """
  WITH d AS (SELECT o_orderkey AS k, o_orderdate + INTERVAL 1 HOUR AS ts FROM orders), x AS (
    SELECT k, ts, CASE k % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%m/%d/%Y %H:%M') WHEN 3 THEN CAST(epoch_ms(ts) AS VARCHAR) WHEN 4 THEN 'soon' END AS raw FROM d)
  SELECT k, CASE WHEN k % 6 IN (0, 1, 2) OR k % 6 = 3 AND regexp_full_match(raw, '[0-9]{13}') THEN CAST(epoch(ts) AS BIGINT) END AS seconds FROM x""")
def _(t):
    ts = (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).cast("timestamp")
    kind = F.col("o_orderkey") % 6
    raw = (F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(kind == 2, F.date_format(ts, "MM/dd/yyyy HH:mm"))
           .when(kind == 3, F.unix_millis(ts).cast("string")).when(kind == 4, F.lit("soon")))
    return t.orders.select(F.col("o_orderkey").alias("k"), F.unix_timestamp(parse_timestamp(raw)).alias("seconds"))


RAW_AMOUNT = "CASE WHEN o_orderkey % 9 = 0 THEN 'abc' WHEN o_orderkey % 9 = 1 THEN NULL WHEN o_orderkey % 9 = 2 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) ELSE ' 1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.50' END"


def raw_amounts(t):
    k = F.col("o_orderkey")
    raw = (F.when(k % 9 == 0, F.lit("abc")).when(k % 9 == 1, F.lit(None)).when(k % 9 == 2, F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
           .otherwise(F.concat(F.lit(" 1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".50"))))
    return t.orders.select("o_orderkey", "o_totalprice", raw.alias("raw"))


@query("str02_parse_amount", f"SELECT o_orderkey, CAST(try_cast(regexp_replace({RAW_AMOUNT}, '[$,\\s]', '', 'g') AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM orders")
def _(t):
    return raw_amounts(t).select("o_orderkey", parse_amount(F.col("raw")).cast("double").alias("amount"))


@query("str03_map_vocabulary", "SELECT CASE lower(trim(v)) WHEN 'f' THEN 'filled' WHEN 'o' THEN 'open' ELSE lower(trim(v)) END AS status, count(*) AS n FROM (SELECT ' ' || o_orderstatus || ' ' AS v FROM orders) GROUP BY 1")
def _(t):
    return t.orders.select(map_vocabulary(F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")), {"f": "filled", "o": "open"}).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("str04_row_hash", "SELECT c_custkey, sha256(concat_ws('||', coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_name END, '<NULL>'), coalesce(c_mktsegment, '<NULL>'), coalesce(CAST(c_nationkey AS VARCHAR), '<NULL>'))) AS h FROM customer")
def _(t):
    return t.customer.select("c_custkey", row_hash(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), "c_mktsegment", "c_nationkey").alias("h"))


@query("str05_would_round", "SELECT count(*) FILTER (o_orderkey % 4 = 0) AS rounded FROM orders")
def _(t):
    raw = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(".125")).otherwise(F.lit(".12")))
    return t.orders.agg(F.count_if(would_round(raw)).alias("rounded"))


@query("str06_normalize_customer_id", """
  WITH x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'c-' || c_custkey WHEN 1 THEN ' ' || c_custkey || ' ' WHEN 2 THEN 'C' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') WHEN 3 THEN 'X' || c_custkey ELSE 'n/a' END AS raw FROM customer)
  SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1, 2) AND c_custkey < 100000 THEN 'C' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS id FROM x""")
def _(t):
    k = F.col("c_custkey")
    s = k.cast("string")
    padded = F.lpad(s, F.greatest(F.lit(5), F.length(s)), "0")  # lpad alone cuts longer keys, to the id of another customer
    raw = F.when(k % 5 == 0, F.concat(F.lit("c-"), s)).when(k % 5 == 1, F.concat(F.lit(" "), s, F.lit(" "))).when(k % 5 == 2, F.concat(F.lit("C"), padded)).when(k % 5 == 3, F.concat(F.lit("X"), s)).otherwise(F.lit("n/a"))
    return t.customer.select("c_custkey", normalize_customer_id(raw).alias("id"))


@query("str07_canonical_uuid", """
  SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS u FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)""")
def _(t):
    h, k = F.md5("c_name"), F.col("c_custkey") % 4
    raw = F.when(k == 0, F.upper(h)).when(k == 1, F.concat(F.lit("{"), h, F.lit("}"))).when(k == 2, F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 24))).otherwise(F.substring(h, 1, 30))
    return t.customer.select("c_custkey", canonical_uuid(raw).alias("u"))


@query("str08_parse_failures", f"SELECT count(*) AS failures FROM (SELECT {RAW_AMOUNT} AS raw FROM orders) WHERE raw IS NOT NULL AND try_cast(regexp_replace(raw, '[$,\\s]', '', 'g') AS DECIMAL(18,2)) IS NULL")
def _(t):
    raw = raw_amounts(t)
    return raw.where(parse_failed(F.col("raw"), parse_amount(F.col("raw")))).agg(F.count(F.lit(1)).alias("failures"))


@query("str09_region_by_volume", """
  WITH s AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'JOBS_US_EAST' WHEN 1 THEN 'SQL_EU_WEST_1' ELSE 'STORAGE' END AS sku, c_custkey % 7 AS q FROM customer)
  SELECT CASE sku WHEN 'JOBS_US_EAST' THEN 'US_EAST' WHEN 'SQL_EU_WEST_1' THEN 'EU_WEST_1' END AS region, CAST(sum(q) AS BIGINT) AS volume FROM s GROUP BY 1""")
def _(t):
    n = F.col("c_nationkey") % 3
    sku = F.when(n == 0, F.lit("JOBS_US_EAST")).when(n == 1, F.lit("SQL_EU_WEST_1")).otherwise(F.lit("STORAGE"))
    return t.customer.groupBy(region_from_sku(sku).alias("region")).agg(F.sum(F.col("c_custkey") % 7).alias("volume"))


@query("str10_positional_similarity", "SELECT n_name, round(CAST((SELECT count(*) FROM range(1, 60) i WHERE substr(n_name, CAST(i.range AS INT), 1) <> '' AND substr(n_name, CAST(i.range AS INT), 1) = substr('NATION_1', CAST(i.range AS INT), 1)) AS DOUBLE) / greatest(length(n_name), 8), 6) AS similarity FROM nation")
def _(t):
    return t.nation.select("n_name", F.round(projections.positional_similarity(F.col("n_name"), F.lit("NATION_1")), 6).alias("similarity"))


@query("agg18_query_fingerprint", """
  WITH q AS (SELECT 'SELECT  * FROM t WHERE a = ' || c_custkey || ' AND b = ''' || c_name || '''' AS q FROM customer)
  SELECT sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(q), '''[^'']*''', '?', 'g'), '\\b[0-9]+(\\.[0-9]+)?\\b', '?', 'g'), '\\s+', ' ', 'g'))) AS shape, count(*) AS n FROM q GROUP BY 1""")
def _(t):
    text = F.concat(F.lit("SELECT  * FROM t WHERE a = "), F.col("c_custkey").cast("string"), F.lit(" AND b = '"), F.col("c_name"), F.lit("'"))
    return t.customer.groupBy(query_fingerprint(text).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("doc01_slug", "SELECT p_partkey, regexp_replace(regexp_replace(trim(lower(p_name || ' & ' || p_brand)), '[^a-z0-9_ \\-]', '', 'g'), ' ', '-', 'g') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"))


@query("tz01_local_date", "SELECT CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS d, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(local_date(F.col("ts"), "America/New_York").alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("tz02_day_hours", """
  SELECT d, CAST(date_diff('second', (d::TIMESTAMP) AT TIME ZONE 'America/New_York', ((d + 1)::TIMESTAMP) AT TIME ZONE 'America/New_York') AS DOUBLE) / 3600 AS hours
  FROM (VALUES (DATE '2026-03-08'), (DATE '2026-07-01'), (DATE '2026-11-01')) AS v(d)""")
def _(t):
    days = t.spark.sql("SELECT * FROM VALUES (DATE '2026-03-08'), (DATE '2026-07-01'), (DATE '2026-11-01') AS v(d)")
    return days.select("d", day_hours(F.col("d"), "America/New_York").cast("double").alias("hours"))


@query("tz03_skipped_and_repeated_times", "SELECT * FROM (VALUES ('2026-03-08 02:30:00', '2026-03-08 07:30:00'), ('2026-11-01 01:30:00', '2026-11-01 05:30:00')) AS v(local_time, instant)")
def _(t):
    rows = t.spark.createDataFrame([("2026-03-08 02:30:00",), ("2026-11-01 01:30:00",)], "local_time string")
    return rows.select("local_time", F.date_format(to_utc(F.col("local_time").cast("timestamp_ntz"), "America/New_York"), "yyyy-MM-dd HH:mm:ss").alias("instant"))


@query("tz04_fixed_offset", "SELECT count(*) FILTER (hour(ts - INTERVAL 5 HOUR) <> hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')) AS differ FROM (SELECT o_orderdate + INTERVAL 12 HOUR AS ts FROM orders)")
def _(t):
    ts = F.col("o_orderdate") + F.expr("INTERVAL 12 HOUR")
    return t.orders.agg(F.count_if(F.hour(fixed_offset_time(ts, "-05:00")) != F.hour(F.from_utc_timestamp(ts, "America/New_York"))).alias("differ"))


@query("fn_scalar_family", """
  SELECT c_custkey, replace(upper(c_name), '#', '-') AS a, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS b, c_mktsegment || '/' || c_nationkey AS c, nullif(c_nationkey, 3) AS d, greatest(c_nationkey, 7) AS e,
         c_custkey % 7 AS f, round(c_acctbal / 3, 3) AS g, sha256(c_name) AS h, md5(c_name) AS i, len(string_split(c_name, '#')) AS j, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS k FROM customer""")
def _(t):
    return t.customer.select(
        "c_custkey", F.regexp_replace(F.upper("c_name"), "#", "-").alias("a"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("b"), F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("c"),
        F.nullif("c_nationkey", F.lit(3)).alias("d"), F.greatest("c_nationkey", F.lit(7)).alias("e"), (F.col("c_custkey") % 7).alias("f"), F.round(F.col("c_acctbal") / 3, 3).alias("g"), F.sha2("c_name", 256).alias("h"), F.md5("c_name").alias("i"),
        F.size(F.split("c_name", "#")).cast("bigint").alias("j"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("ok").alias("k"))


@query("fn_dates_and_json", """
  SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS d, CAST(date_trunc('week', ts) AS DATE) AS w, CAST(year(ts) AS INT) AS y, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS days, CAST(ts AS DATE) + 7 AS later FROM events""")
def _(t):
    return t.events.select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_date("ts").alias("d"), F.to_date(F.date_trunc("week", "ts")).alias("w"), F.year("ts").alias("y"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("days"), F.date_add(F.to_date("ts"), 7).alias("later"))
