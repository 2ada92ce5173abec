"""Streams, plans, specifications and scaling."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import errors as E
from millrace import plans, streaming
from millrace.operators import joins, windows
from millrace.plans import metrics, spec
from millrace.sources import generate
from millrace.sources.generate import ACCOUNTS, HOT_PAYMENTS, PAYMENTS
from millrace.table import VersionedTable

EVENTS = "event_id STRING, customer_id STRING, event_ts TIMESTAMP, amount INT"


def put(spark, path, *rows):
    data = [(e, c, dt.datetime.fromisoformat(t), a) for e, c, t, a in rows]
    spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(EVENTS).parquet(path)


def test_a_checkpoint_processes_each_row_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    put(spark, src, ("e1", "C1", "2026-01-01 10:00:00", 1), ("e2", "C1", "2026-01-01 10:01:00", 2))
    assert streaming.run_available_now(source(spark, src), out, cp).input_rows == 2
    assert streaming.run_available_now(source(spark, src), out, cp).input_rows == 0
    put(spark, src, ("e3", "C1", "2026-01-01 10:02:00", 3))
    assert streaming.run_available_now(source(spark, src), out, cp).input_rows == 1
    assert spark.read.parquet(out).count() == 3


def test_windows_wait_for_the_watermark_and_late_rows_are_dropped(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    run = lambda: streaming.run_available_now(streaming.windowed_sum(source(spark, src), "event_ts", "amount"), out, cp)
    put(spark, src, ("e1", "C1", "2026-01-01 10:00:00", 1))
    run()
    assert spark.read.schema("total BIGINT").parquet(out).count() == 0
    put(spark, src, ("e2", "C1", "2026-01-01 10:30:00", 2))
    run()
    assert [r.total for r in spark.read.parquet(out).collect()] == [1]
    put(spark, src, ("e3", "C1", "2026-01-01 10:05:00", 4))
    assert sum(run().dropped_late) == 1
    assert [r.total for r in spark.read.parquet(out).collect()] == [1]


def test_a_constant_watermark_never_emits(spark, tmp_path):
    src = str(tmp_path / "src")
    put(spark, src, ("e1", "C1", "2026-01-01 10:00:00", 1))
    p = streaming.run_available_now(streaming.latest_per_key_constant_watermark(source(spark, src), "customer_id", "event_ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert p.input_rows == 1 and spark.read.schema(EVENTS).parquet(str(tmp_path / "out")).count() == 0


def test_output_modes_and_watermarks_are_demanded(spark, tmp_path):
    src = str(tmp_path / "src")
    put(spark, src, ("e1", "C1", "2026-01-01 10:00:00", 1))
    s = source(spark, src)
    with pytest.raises(E.UnsupportedOutputMode):
        streaming.run_available_now(s, str(tmp_path / "o"), str(tmp_path / "c"), "update")
    with pytest.raises(E.UnsupportedOutputMode):
        streaming.sink_table(s, None, str(tmp_path / "c"), "f", mode="update")
    with pytest.raises(E.MissingWatermark):
        streaming.stream_join(s, s, "customer_id", "event_ts", "event_ts", "1 HOUR", None)
    a, b = s.alias("a"), source(spark, src).alias("b")
    with pytest.raises(Exception) as caught:  # Spark itself refuses the outer join at its start
        a.join(b, F.col("a.event_id") == F.col("b.event_id"), "left").select("a.event_id").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "x")).start()
    assert "watermark" in str(caught.value).lower()


def test_inner_join_without_watermark_keeps_all_rows(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    put(spark, a, ("e1", "C1", "2026-01-01 10:00:00", 1))
    put(spark, b, ("e2", "C1", "2026-01-01 10:00:00", 1))
    joined = source(spark, a).alias("a").join(source(spark, b).alias("b"), F.col("a.customer_id") == F.col("b.customer_id")).select(F.col("a.event_id").alias("x"), F.col("b.event_id").alias("y"))
    run = lambda: streaming.run_available_now(joined, str(tmp_path / "o"), str(tmp_path / "c")).state_rows
    first = run()
    put(spark, a, ("e3", "C2", "2026-01-01 10:00:00", 1))
    put(spark, b, ("e4", "C3", "2026-01-01 10:00:00", 1))
    assert run() == first + 2 and spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_the_static_side_is_read_anew_for_each_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    dim = VersionedTable.create_from(spark.createDataFrame([("C1", "SMB")], "customer_id string, segment string"), str(tmp_path / "dim"))
    out = VersionedTable.create(spark, str(tmp_path / "out"), f"{EVENTS}, segment STRING")
    run = lambda: streaming.enrich_per_batch(source(spark, src), dim.read_latest(), ["customer_id"], out, str(tmp_path / "cp"), "f")
    put(spark, src, ("e1", "C1", "2026-01-01 10:00:00", 1))
    run()
    dim.overwrite(spark.createDataFrame([("C1", "Enterprise")], "customer_id string, segment string"))
    put(spark, src, ("e2", "C1", "2026-01-01 10:01:00", 1))
    run()
    assert sorted((r.event_id, r.segment) for r in out.read().collect()) == [("e1", "SMB"), ("e2", "Enterprise")]


def test_plan_shapes(spark):
    s, c = generate(spark, PAYMENTS, 20_000), generate(spark, ACCOUNTS, 800)
    with plans.conf(spark, spark__sql__adaptive__enabled="false"):
        assert plans.exchange_count(s.where("paid > 5").select("payment")) == 0
        assert plans.exchange_count(s.groupBy("account").count()) == 1
        assert plans.join_strategies(s.join(c, "account")) == ["BroadcastHashJoin"]
        with plans.conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
            j = s.join(c, "account")
            assert plans.join_strategies(j) == ["SortMergeJoin"] and plans.exchange_count(j) == 2
        top = windows.top_n(s, ["account"], [F.desc("paid"), F.col("payment")], 3)
        assert plans.executed_plan(top).count("WindowGroupLimit") == 2
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_salting_spreads_a_hot_key(spark):
    with plans.conf(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="16"):
        big, small = generate(spark, HOT_PAYMENTS, 50_000), generate(spark, ACCOUNTS, 800)
        plain = plans.partition_sizes(big.join(small, "account"))
        salted = plans.partition_sizes(joins.salted_join(big, small, ["account"]))
    assert sum(plain) == sum(salted) and plain[0] > 0.85 * sum(plain) and salted[0] < 0.45 * sum(salted)


def test_adaptive_execution_splits_a_hot_partition(spark):
    settings = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "64k", "spark__sql__adaptive__advisoryPartitionSizeInBytes": "64k", "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2"}
    with plans.conf(spark, **settings):
        df = generate(spark, HOT_PAYMENTS, 200_000).join(generate(spark, ACCOUNTS, 800), "account")
        df.collect()
        assert "skew=true" in plans.executed_plan(df)


def test_pruning_determinism_and_udf_nodes(spark, tmp_path):
    path = str(tmp_path / "p")
    generate(spark, PAYMENTS, 1000).write.partitionBy("day").parquet(path)
    df = spark.read.parquet(path).where("day = '2024-02-05' AND paid > 3").select("payment")
    seen = plans.pruning(df)
    assert "day" in seen["PartitionFilters"][0] and "GreaterThan(paid" in seen["PushedFilters"][0] and "account" not in seen["ReadSchema"][0]
    with pytest.raises(E.NondeterministicPlan):
        plans.require_deterministic(generate(spark, PAYMENTS, 10).dropDuplicates(["account"]))
    plans.require_deterministic(windows.latest_per_key(generate(spark, PAYMENTS, 10), ["account"], [F.col("payment")]))
    from millrace.queries.relational import upper_by_batch, upper_by_row
    text = spark.createDataFrame([("a",)], "s string")
    assert "BatchEvalPython" in plans.executed_plan(text.select(upper_by_row("s"))) and "ArrowEvalPython" in plans.executed_plan(text.select(upper_by_batch("s")))
    assert "EvalPython" not in plans.executed_plan(text.select(F.upper("s")))


def test_small_helpers(spark):
    assert 0.0002 < plans.collision_probability(100_000_000) < 0.0003
    assert plans.timed(lambda: None, 2) >= 0
    with plans.ansi_off(spark):
        assert spark.sql("SELECT cast('x' AS INT)").first()[0] is None


SPEC = {"nodes": [{"name": "a", "sources": [{"table": "raw"}], "filter": "x > 0"}]}


@pytest.mark.parametrize("bad", [
    {"nodes": []}, {"nope": 1, **SPEC}, {"nodes": [{"name": "a", "sources": [{"table": "raw"}], "colour": 1}]}, {"nodes": [{"name": "a", "sources": [{"table": "missing"}]}]},
    {"nodes": [{"name": "a", "sources": [{"table": "b"}]}, {"name": "b", "sources": [{"table": "a"}]}]}, {"nodes": [{"name": "a", "sources": [{"table": "raw"}], "filter": "${x}"}]},
    {"nodes": [{"name": "a", "sources": [{"table": "raw"}], "cdc": {"keys": ["k"]}}]}, {"nodes": [{"name": "a", "sources": [{"table": "raw"}], "template": "t"}]},
])
def test_invalid_specifications_raise(spark, bad):
    with pytest.raises(E.InvalidSpec):
        spec.run(bad, {"raw": spark.range(1)})


def test_specification_runs(spark):
    raw = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, seq int, v string")
    out = spec.run({"nodes": [{"name": "s", "sources": [{"table": "raw"}], "rules": {"v": "v IS NOT NULL"}, "quarantine": "table", "cdc": {"keys": ["k"], "sequence_by": "seq", "scd": 1}}]}, {"raw": raw})
    assert [tuple(r) for r in out["s"].select("k", "v").collect()] == [(1, "b")] and out["s__quarantine"].count() == 1


def test_metric_views(spark):
    t = spark.createDataFrame([("a", "x", 1, 10), ("a", "x", 2, 20), ("b", "x", 1, 5)], "e string, g string, d int, v int")
    view = metrics.load("source: t\ndimensions: {g: t_g}\nmeasures: {n: 'count(1)', mean: 'MEASURE(total) / MEASURE(n)', total: 'sum(t_v)'}\nsemi_additive: {closing: {value: t_v, order: t_d, entity: [t_e]}}")
    got = metrics.metric_view(view, {"t": t}, ["g"], ["n", "mean", "closing"]).first()
    assert (got.n, round(got.mean, 3), got.closing) == (3, 11.667, 25)
    with pytest.raises(E.InvalidSpec):
        metrics.metric_view({**view, "measures": {"a": "MEASURE(b)", "b": "MEASURE(a)"}}, {"t": t}, [], ["a"])
    with pytest.raises(E.InvalidSpec):
        metrics.metric_view(view, {"t": t}, ["g"], ["nope"])
