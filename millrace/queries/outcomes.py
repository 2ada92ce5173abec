"""What operators refuse, how plans look, and when streams emit: one row for each case."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from .. import plans
from .. import streaming as S
from ..operators import history, joins, windows
from ..plans.inspect import run_noop
from ..plans.spec import run as run_spec
from ..session import get_spark
from ..sources import generate
from ..sources.generate import ACCOUNTS, HOT_PAYMENTS, PAYMENTS
from ..table import VersionedTable
from .changes import loaded, place
from .registry import query


def cases(t, **actions: Callable[[], object]) -> DataFrame:
    """The outcome of each action: its value as text, or the condition of its error."""
    rows = [(name, str(E.attempt(action)[1])) for name, action in actions.items()]
    return t.spark.createDataFrame(rows, "name string, outcome string")


def expect(**outcomes: str) -> str:
    """SQL for the rows that ``cases`` must give."""
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in outcomes.items()) + ") AS v(name, outcome)"


# ---- tables

@query("snk05_repeated_source_keys", expect(update="MULTIPLE_SOURCE_ROW_MATCHING_TARGET_ROW_IN_MERGE", unchanged="True", insert_only="1"))
def _(t):
    """Two source rows for a target row are refused where one would update it, and not where rows are only inserted."""
    table = loaded(t)
    twice = table.read().limit(3)
    twice = twice.unionByName(twice)
    return cases(
        t, update=lambda: table.merge(twice, ["o_orderkey"], update="*", insert="*"), unchanged=lambda: table.version() == 1 and table.read().count() == t.orders.count(),
        insert_only=lambda: table.merge(twice, ["o_orderkey"], insert="*") - 1)


@query("tbl03_pinned_and_latest", "SELECT count(*) AS pinned, 2 * count(*) AS latest FROM region")
def _(t):
    """A snapshot stays what it was; what resolves the table anew sees the append."""
    table = VersionedTable.create_from(t.region, place(t, "pinned"))
    pinned, latest = table.read(), table.read_latest()
    table.append(t.region)
    return t.spark.createDataFrame([(pinned.count(), latest().count())], "pinned bigint, latest bigint")


@query("tbl05_constraints", expect(check="VIOLATE_CONSTRAINT_WITH_VALUES", null_in_check="VIOLATE_CONSTRAINT_WITH_VALUES", not_null="NOT_NULL_CONSTRAINT_VIOLATED", missing="MISSING_NOT_NULL_COLUMN_VALUE", version="0"))
def _(t):
    table = VersionedTable.create(t.spark, place(t, "constraints"), "k BIGINT, price DOUBLE", not_null=["k"], checks={"priced": "price > 0"})
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return cases(
        t, check=lambda: table.append(rows.withColumn("price", -F.col("price"))), null_in_check=lambda: table.append(rows.withColumn("price", F.lit(None).cast("double"))),
        not_null=lambda: table.append(rows.withColumn("k", F.lit(None).cast("bigint"))), missing=lambda: table.append(rows.select("price")), version=table.version)


@query("tbl07_duplicate_columns", expect(create="DUPLICATE_COLUMNS_FOUND", append="DUPLICATE_COLUMNS_FOUND"))
def _(t):
    twice = t.region.select("r_name", "r_name")
    table = VersionedTable.create_from(t.region, place(t, "duplicates"))
    return cases(t, create=lambda: VersionedTable.create_from(twice, place(t, "twice")), append=lambda: table.append(twice))


@query("flt05_partitions_and_data", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(t):
    """Partitions are chosen before the scan; the price reaches it as a pushed filter."""
    table = VersionedTable.create_from(t.orders, place(t, "partitions"), partition_by=["o_orderstatus"])
    return table.read(partitions={"o_orderstatus": ["F"]}).where("o_totalprice > 100000").select("o_orderkey", "o_orderpriority")


@query("inc07_naive_history", expect(one_change="2", two_changes="MULTIPLE_SOURCE_ROW_MATCHING_TARGET_ROW_IN_MERGE"))
def _(t):
    """Merging on the key alone fails once a key changes twice in a batch."""
    at = lambda day: t.region.select("r_regionkey", F.lit(f"name {day}").alias("r_name"), F.lit(f"2024-01-0{day}").cast("timestamp").alias("at"))

    def merged(batch: DataFrame) -> int:
        table = VersionedTable.create_from(history.build_scd2(at(1), ["r_regionkey"], ["r_name"], "at"), place(t, "naive"))
        history.naive_scd2(table, batch, ["r_regionkey"], ["r_name"], "at")
        return table.version()

    return cases(t, one_change=lambda: merged(at(2)), two_changes=lambda: merged(at(3).unionByName(at(4))))


# ---- names, ranks and specifications

@query("jn22_ambiguous_reference", expect(ambiguous="AMBIGUOUS_REFERENCE", qualified="ok"))
def _(t):
    both = t.region.alias("a").join(t.region.alias("b"), F.col("a.r_regionkey") == F.col("b.r_regionkey"))
    return cases(t, ambiguous=lambda: both.select("r_name"), qualified=lambda: both.select("a.r_name") and "ok")


@query("win11_global_rank", expect(unpartitioned="INVALID_SPEC", partitioned="ok"))
def _(t):
    """A rank without partition keys would sort all rows in one task."""
    by = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return cases(t, unpartitioned=lambda: windows.rank_within(t.orders, [], by), partitioned=lambda: windows.rank_within(t.orders, ["o_custkey"], by) and "ok")


@query("srt04_arbitrary_rows", expect(sort_and_drop="NONDETERMINISTIC_PLAN", ranked="ok"))
def _(t):
    """Sorting before dropDuplicates doesn't choose the row that stays."""
    by = [F.desc("o_orderdate"), F.col("o_orderkey")]
    return cases(t, sort_and_drop=lambda: plans.require_deterministic(t.orders.orderBy(*by).dropDuplicates(["o_custkey"])),
                 ranked=lambda: plans.require_deterministic(windows.latest_per_key(t.orders, ["o_custkey"], by)) or "ok")


BAD_SPECS = {
    "nothing": {"nodes": []}, "unknown_key": {"nodes": [{"name": "a", "sources": [{"table": "raw"}], "colour": 1}]}, "unknown_source": {"nodes": [{"name": "a", "sources": [{"table": "missing"}]}]},
    "cycle": {"nodes": [{"name": "a", "sources": [{"table": "b"}]}, {"name": "b", "sources": [{"table": "a"}]}]}, "unknown_token": {"nodes": [{"name": "a", "sources": [{"table": "raw"}], "filter": "${x}"}]},
    "cdc_without_sequence": {"nodes": [{"name": "a", "sources": [{"table": "raw"}], "cdc": {"keys": ["k"]}}]},
}


@query("dsl04_invalid_specifications", expect(**dict.fromkeys(BAD_SPECS, "INVALID_SPEC")))
def _(t):
    return cases(t, **{name: lambda s=s: run_spec(s, {"raw": t.region}) for name, s in BAD_SPECS.items()})


@query("errors_taxonomy", expect(engine="JOIN_FAN_OUT", analysis="UNRESOLVED_COLUMN.WITH_SUGGESTION", parse="PARSE_SYNTAX_ERROR", cast="CAST_INVALID_INPUT", missing="TABLE_OR_VIEW_NOT_FOUND", python="ZeroDivisionError"))
def _(t):
    """Conditions of the engine's own errors, of Spark's, and of others (PLN-09)."""
    def fail():
        raise E.FanOut("3 rows became 4")

    return cases(t, engine=fail, analysis=lambda: t.region.select("r_nam"), parse=lambda: t.spark.sql("SELEC 1"), cast=lambda: t.spark.sql("SELECT cast('x' AS INT)").collect(),
                 missing=lambda: VersionedTable(t.spark, place(t, "nowhere")).read(), python=lambda: 1 // 0)


# ---- plans

@query("pln01_02_05_plan_shapes", expect(filter="0", aggregate="1", window="1", small_join="BroadcastHashJoin 0", large_join="SortMergeJoin 2"))
def _(t):
    """Shuffles and join strategies, read from physical plans without adaptive execution."""
    facts, accounts = generate(t.spark, PAYMENTS, 20_000), generate(t.spark, ACCOUNTS, 800)
    joined = lambda: facts.join(accounts, "account")
    shape = lambda df: f"{' '.join(plans.join_strategies(df))} {plans.exchange_count(df)}"

    def large():
        with plans.conf(t.spark, spark__sql__autoBroadcastJoinThreshold="-1"):
            return shape(joined())

    with plans.conf(t.spark, spark__sql__adaptive__enabled="false"):
        return cases(t, filter=lambda: plans.exchange_count(facts.where("paid > 5")), aggregate=lambda: plans.exchange_count(facts.groupBy("account").count()),
                     window=lambda: plans.exchange_count(windows.top_n(facts, ["account"], [F.desc("paid"), F.col("payment")], 3)), small_join=lambda: shape(joined()), large_join=large)


@query("pln03_10_scoped_settings", expect(inside="7", after="True", ansi_on="CAST_INVALID_INPUT", ansi_off="None"))
def _(t):
    before = t.spark.conf.get("spark.sql.shuffle.partitions")

    def inside():
        with plans.conf(t.spark, spark__sql__shuffle__partitions="7"):
            return t.spark.conf.get("spark.sql.shuffle.partitions")

    def off():
        with plans.ansi_off(t.spark):
            return t.spark.sql("SELECT cast('x' AS INT)").first()[0]

    return cases(t, inside=inside, after=lambda: t.spark.conf.get("spark.sql.shuffle.partitions") == before, ansi_on=lambda: t.spark.sql("SELECT cast('x' AS INT)").first(), ansi_off=off)


@query("pln04_rows_of_tasks", expect(plain="True", salted="True", same_rows="True"))
def _(t):
    """A hot key fills one task; salted it doesn't."""
    with plans.conf(t.spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="16"):
        facts, accounts = generate(t.spark, HOT_PAYMENTS, 50_000), generate(t.spark, ACCOUNTS, 800)
        plain, salted = (plans.partition_sizes(j) for j in (facts.join(accounts, "account"), joins.salted_join(facts, accounts, ["account"])))
    return cases(t, plain=lambda: plain[0] > 0.85 * sum(plain), salted=lambda: salted[0] < 0.45 * sum(salted), same_rows=lambda: sum(plain) == sum(salted))


@query("pln06_08_pruning", expect(partition="True", pushed="True", columns="True", arbitrary="NONDETERMINISTIC_PLAN"))
def _(t):
    folder = place(t, "pruning")
    generate(t.spark, PAYMENTS, 1000).write.partitionBy("day").parquet(folder)
    seen = plans.pruning(t.spark.read.parquet(folder).where("day = '2024-02-05' AND paid > 3").select("payment"))
    return cases(t, partition=lambda: "day" in seen["PartitionFilters"][0], pushed=lambda: "GreaterThan(paid" in seen["PushedFilters"][0], columns=lambda: "account" not in seen["ReadSchema"][0],
                 arbitrary=lambda: plans.require_deterministic(generate(t.spark, PAYMENTS, 10).dropDuplicates(["account"])))


@query("pln07_11_snk10_udf04", expect(timed="True", noop="None", collisions="0.0003", interpreter="True"))
def _(t):
    """Best of two runs into a sink that keeps nothing; the chance of equal hashes; the workers' interpreter."""
    get_spark()
    with_version = lambda batches: (b.assign(v=".".join(map(str, sys.version_info[:2]))) for b in batches)
    workers = lambda: {r.v for r in t.region.select("r_name").mapInPandas(with_version, "r_name string, v string").collect()}
    return cases(t, timed=lambda: 0 < plans.timed(lambda: run_noop(t.region), 2) < 60, noop=lambda: run_noop(t.orders), collisions=lambda: f"{plans.collision_probability(100_000_000):.4f}",
                 interpreter=lambda: workers() == {".".join(map(str, sys.version_info[:2]))})


# ---- streams

EVENTS = "event STRING, account STRING, at TIMESTAMP, amount INT"


class Feed:
    """A folder of event files, and a place for a stream's sink and checkpoint."""

    def __init__(self, t, name: str):
        self.spark, self.base = t.spark, place(t, name)

    def put(self, side: str, *rows: tuple) -> None:
        data = [(e, a, dt.datetime.fromisoformat(f"2024-03-01 {at}"), n) for e, a, at, n in rows]
        self.spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(f"{self.base}/{side}")

    def stream(self, side: str) -> DataFrame:
        return self.spark.readStream.schema(EVENTS).parquet(f"{self.base}/{side}")

    def run(self, df: DataFrame) -> S.Progress:
        return S.run_available_now(df, f"{self.base}/out", f"{self.base}/checkpoint")

    def out(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/out")


@query("stm04_constant_watermark", "SELECT CAST(1 AS BIGINT) AS rows_in, CAST(0 AS BIGINT) AS rows_out")
def _(t):
    """A watermark on a constant never passes anything, so that nothing comes out."""
    feed = Feed(t, "constant")
    feed.put("in", ("e1", "A", "10:00:00", 1))
    p = feed.run(S.latest_per_key_constant_watermark(feed.stream("in"), "account", "at"))
    return t.spark.createDataFrame([(p.input_rows, feed.out(EVENTS).count())], "rows_in bigint, rows_out bigint")


@query("stm05_14_late_rows", "SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1)) AS v(run, windows_out, late_rows)")
def _(t):
    """Windows wait for the watermark; a row behind it is dropped, and the progress counts it."""
    feed, rows = Feed(t, "late"), []
    for run, row in enumerate((("e1", "A", "10:00:00", 1), ("e2", "A", "10:30:00", 2), ("e3", "A", "10:05:00", 4))):
        feed.put("in", row)
        p = feed.run(S.windowed_sum(feed.stream("in"), "at", "amount"))
        rows.append((run, feed.out("total BIGINT").count(), sum(p.dropped_late)))
    return t.spark.createDataFrame(rows, "run int, windows_out int, late_rows int")


@query("stm07_tbl10_refused_streams", expect(outer_join="True", engine_join="MISSING_WATERMARK", update_to_files="UNSUPPORTED_OUTPUT_MODE", update_to_table="UNSUPPORTED_OUTPUT_MODE"))
def _(t):
    """Outer joins of streams need watermarks; files and tables without keys take appended rows alone."""
    feed = Feed(t, "refused")
    feed.put("in", ("e1", "A", "10:00:00", 1))
    s = feed.stream("in")

    def outer():
        joined = s.alias("a").join(feed.stream("in").alias("b"), F.col("a.event") == F.col("b.event"), "left").select("a.event")
        try:
            joined.writeStream.format("noop").option("checkpointLocation", f"{feed.base}/x").start().stop()
        except Exception as error:
            return "watermark" in str(error).lower()
        return False

    return cases(t, outer_join=outer, engine_join=lambda: S.stream_join(s, s, "account", "at", "at", "1 HOUR", None), update_to_files=lambda: S.run_available_now(s, f"{feed.base}/o", f"{feed.base}/c", "update"),
                 update_to_table=lambda: S.sink_table(s, None, f"{feed.base}/d", "f", mode="update"))


@query("stm08_unbounded_state", "SELECT * FROM (VALUES (0, 2, 1), (1, 4, 1), (2, 6, 1)) AS v(run, state_rows, rows_out)")
def _(t):
    """An inner join without watermarks keeps every row for ever."""
    feed, rows = Feed(t, "state"), []
    for run, (a, b) in enumerate((("A", "A"), ("B", "C"), ("D", "E"))):
        feed.put("left", (f"l{run}", a, "10:00:00", 1))
        feed.put("right", (f"r{run}", b, "10:00:00", 1))
        joined = feed.stream("left").alias("a").join(feed.stream("right").alias("b"), F.col("a.account") == F.col("b.account")).select(F.col("a.event").alias("x"), F.col("b.event").alias("y"))
        p = feed.run(joined)
        rows.append((run, p.state_rows, feed.out("x STRING, y STRING").count()))
    return t.spark.createDataFrame(rows, "run int, state_rows int, rows_out int")
