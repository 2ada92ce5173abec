"""Files in several formats, layered loads, and streams of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import streaming as S
from ..operators import incremental
from ..plans.lake import ORDERS, Lake
from ..sources import discover, read_batch, read_csv, read_inferred, read_json_lines
from ..table import VersionedTable
from .changes import place
from .registry import query

RAW = "o_orderkey STRING, o_custkey STRING, o_orderstatus STRING, o_totalprice STRING, o_orderdate STRING, changed STRING"


def lines(orders: DataFrame, **columns) -> DataFrame:
    """Orders as JSON lines of text; ``columns`` replace those of ORDERS."""
    key = F.col("o_orderkey")
    raw = {
        "o_orderkey": F.concat(F.lit(" "), key, F.lit(" ")), "o_custkey": F.when(key % 11 != 0, F.col("o_custkey").cast("string")),
        "o_orderstatus": F.when(F.col("o_orderstatus") == "O", " open").when(F.col("o_orderstatus") == "F", "Finished").otherwise(F.lower("o_orderstatus")),
        "o_totalprice": F.when(key % 13 == 0, "unknown").otherwise(F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))),
        "o_orderdate": F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")), "changed": F.lit("1"), **columns}
    whole = F.to_json(F.struct(*(v.alias(k) for k, v in raw.items())))
    return orders.select(F.when(key % 17 == 0, F.substring(whole, 1, 16)).otherwise(whole).alias("value"))


def files(t, name: str, text: DataFrame) -> list[str]:
    folder = place(t, name)
    text.write.text(folder)
    return sorted(t.spark.read.text(folder).inputFiles())


def first(t) -> list[str]:
    return files(t, "first", lines(t.orders))


def second(t) -> list[str]:
    """Each fifth order again, finished; half of them with a price that no order has."""
    key = F.col("o_orderkey")
    price = F.when(key % 10 == 0, "-1").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return files(t, "second", lines(t.orders.where(key % 5 == 0), o_orderstatus=F.lit("F"), o_totalprice=price, changed=F.lit("2")))


@query("src01_json_lines", "SELECT o_orderkey % 17 = 0 AS broken, count(*) AS n, CAST(count(*) FILTER (o_orderkey % 17 <> 0) AS BIGINT) AS with_key FROM orders GROUP BY 1")
def _(t):
    """Broken lines keep their text and are NULL elsewhere."""
    read = read_json_lines(t.spark, first(t), RAW)
    return read.groupBy(F.col("_corrupt_record").isNotNull().alias("broken")).agg(F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("with_key"))


@query("src02_csv", "SELECT c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def _(t):
    folder = place(t, "csv")
    t.customer.select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"), "c_mktsegment").write.option("header", True).csv(folder)
    return read_csv(t.spark, folder, "c_custkey BIGINT, c_name STRING, c_acctbal DECIMAL(18,2), c_mktsegment STRING").withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query("src03_lineage", "SELECT count(*) AS n, count(*) AS named, CAST(0 AS BIGINT) AS from_elsewhere FROM orders")
def _(t):
    """Each row knows its file; the file's name ends its path."""
    paths = first(t)
    names = [p.rsplit("/", 1)[1] for p in paths]
    read = read_json_lines(t.spark, paths, RAW)
    return read.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.endswith("_source_file", "_source_file_name") & F.col("_ingested_at").isNotNull()).alias("named"), F.count_if(~F.col("_source_file_name").isin(names)).alias("from_elsewhere"))


@query("src06_stream_of_commits", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS round FROM customer")
def _(t):
    """Two appends, a run after each; a file that no commit names isn't read."""
    base = place(t, "commits")
    table = VersionedTable.create(t.spark, f"{base}/table", "c_custkey BIGINT, round INT")
    for round, rows in enumerate((t.customer.where("c_custkey % 3 <> 0"), t.customer.where("c_custkey % 3 = 0"))):
        table.append(rows.select("c_custkey", F.lit(round).alias("round")))
        t.spark.range(7).select(F.col("id").alias("c_custkey"), F.lit(9).alias("round")).write.parquet(f"{table.path}/data/orphan{round}")
        S.run_available_now(table.read_stream(), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.schema("c_custkey BIGINT, round INT").parquet(f"{base}/out")


@query("src09_inference", "SELECT * FROM (VALUES ('amount', 'string'), ('id', 'bigint')) AS v(name, kind)")
def _(t):
    """One value that is no number makes a column text."""
    rows = t.region.select(F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.when(F.col("r_regionkey") == 3, "n/a").otherwise(F.lit("1")).alias("amount"))).alias("value"))
    rows = rows.select(F.regexp_replace("value", '"1"', "1").alias("value"))
    found = read_inferred(t.spark, files(t, "inferred", rows)[0].rsplit("/", 1)[0])
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in found.schema], "name string, kind string")


@query("src10_existence", "SELECT * FROM (VALUES ('after', true), ('before', false)) AS v(moment, found)")
def _(t):
    path = place(t, "existence")
    before = VersionedTable.exists(t.spark, path)
    VersionedTable.create_from(t.region, path)
    return t.spark.createDataFrame([("before", before), ("after", VersionedTable.exists(t.spark, path))], "moment string, found boolean")


@query("src11_discovery", """
  SELECT run, count(*) AS n, CAST(count(*) FILTER (run = 1) AS BIGINT) AS rescued FROM (SELECT 0 AS run FROM nation UNION ALL SELECT 1 FROM nation WHERE n_regionkey < 2) GROUP BY run""")
def _(t):
    """Files are found once; what the schema doesn't name yet is kept beside it."""
    base, out = place(t, "discovery"), []
    later = t.nation.where("n_regionkey < 2").select(F.col("n_nationkey"), F.lit(1).alias("run"), F.col("n_name").alias("added"))
    for rows in (t.nation.select("n_nationkey", F.lit(0).alias("run")), later):
        rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(f"{base}/in")
        S.run_available_now(discover(t.spark, f"{base}/in", "n_nationkey INT, run INT"), f"{base}/out", f"{base}/checkpoint")
        out.append(1)
    return t.spark.read.parquet(f"{base}/out").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count("_rescued_data").alias("rescued"))


KINDS = ("csv", "json", "orc", "parquet", "text", "xml")


@query("src13_formats", "SELECT kind, r_name FROM region CROSS JOIN (VALUES ('csv'), ('json'), ('orc'), ('parquet'), ('text'), ('xml')) AS k(kind)")
def _(t):
    out = None
    for kind in KINDS:
        folder = place(t, kind)
        options = {"rowTag": "row"} if kind == "xml" else {}
        schema = None if kind in ("parquet", "orc") else "value STRING" if kind == "text" else "r_name STRING"
        names = t.region.select(F.col("r_name").alias("value" if kind == "text" else "r_name"))
        names.write.format(kind).options(**options).save(folder)
        read = read_batch(t.spark, kind, folder, schema, **options).toDF("r_name").select(F.lit(kind).alias("kind"), "r_name")
        out = read if out is None else out.unionByName(read)
    return out


@query("snk02_file_ledger", "SELECT * FROM (VALUES (0, 2), (1, 1), (2, 0)) AS v(run, files)")
def _(t):
    """Files are loaded once, by name; a run without new files commits nothing."""
    paths = [p for r in (0, 1, 2) for p in files(t, "ledger", lines(t.orders.where(F.col("o_orderkey") % 3 == r)).coalesce(1))]
    table = VersionedTable.create(t.spark, place(t, "ledger-table"), f"{RAW}, _corrupt_record STRING, _source_file STRING, _source_file_name STRING, _ingested_at TIMESTAMP")
    read = lambda spark, new: read_json_lines(spark, new, RAW)
    taken = [len(incremental.ingest_files(table, given, read)) for given in (paths[:2], paths, paths)]
    return t.spark.createDataFrame(list(enumerate(taken)), "run int, files int")


VALID = "o_orderkey % 17 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey > 0 AND o_totalprice > 0 AND o_orderdate >= DATE '1990-01-01'"


@query("inc01_lake_current", f"""
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN 'F' ELSE o_orderstatus END AS status, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(o_orderdate AS DATE) AS day,
         CAST(CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN 2 ELSE 1 END AS BIGINT) AS changed
  FROM orders WHERE {VALID} AND (o_orderkey % 13 <> 0 OR o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0)""")
def _(t):
    """Two loads: the newest valid row of each order; an invalid newer one leaves the older."""
    lake = Lake(t.spark, place(t, "lake"), ORDERS)
    one = first(t)
    lake.load(one)
    lake.load([*one, *second(t)])
    return lake.current.read().select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderdate").alias("day"), "changed")


@query("inc01_lake_refused", """
  WITH f AS (SELECT o_orderkey AS k, o_orderkey % 17 = 0 AS broken, false AS again FROM orders UNION ALL SELECT o_orderkey, o_orderkey % 17 = 0, true FROM orders WHERE o_orderkey % 5 = 0),
  r AS (SELECT unnest(CASE WHEN broken THEN ['keyed', 'has_customer', 'state_is_known', 'worth_something', 'dated', 'sequenced']
                           ELSE list_filter([CASE WHEN k % 11 = 0 THEN 'has_customer' END, CASE WHEN CASE WHEN again THEN k % 10 = 0 ELSE k % 13 = 0 END THEN 'worth_something' END], lambda x: x IS NOT NULL) END) AS rule FROM f)
  SELECT rule, count(*) AS n FROM r GROUP BY rule""")
def _(t):
    """Why rows were refused, by rule; a row may fail several."""
    lake = Lake(t.spark, place(t, "lake"), ORDERS)
    lake.load([*first(t), *second(t)])
    return lake.refused.read().select(F.explode("dq_failures").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("inc02_three_loads", f"""
  WITH f AS (SELECT 0 AS run, {VALID} AND o_orderkey % 13 <> 0 AS ok FROM orders UNION ALL SELECT 1, {VALID} AND o_orderkey % 10 <> 0 FROM orders WHERE o_orderkey % 5 = 0)
  SELECT run, true AS loaded, CAST(count(*) FILTER (ok) AS BIGINT) AS valid, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS refused FROM f GROUP BY run
  UNION ALL SELECT 2, false, 0, 0""")
def _(t):
    """New files, old and new files, and nothing new."""
    lake, one = Lake(t.spark, place(t, "lake"), ORDERS), first(t)
    both = [*one, *second(t)]
    runs = [lake.load(given) for given in (one, both, both)]
    return t.spark.createDataFrame([(k, bool(r.files), r.valid, r.refused) for k, r in enumerate(runs)], "run int, loaded boolean, valid bigint, refused bigint")
