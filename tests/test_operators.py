"""Joins, windows, aggregates, quality rules, scores."""

import pytest
from pyspark.sql import functions as F

from millrace.errors import AmbiguousRule, ContractViolated, DuplicateKeys, FanOut, InvalidSpec, QualityGateFailed, UnknownKey
from millrace.operators import aggregates, history, joins, quality, windows


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_safe_left_join_refuses_repeated_keys(spark):
    fact = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    with pytest.raises(DuplicateKeys):
        joins.safe_left_join(fact, spark.createDataFrame([(1, "a"), (1, "b")], "k int, n string"), ["k"])
    assert rows(joins.safe_left_join(fact, spark.createDataFrame([(1, "a"), (None, "x"), (None, "y")], "k int, n string"), ["k"]), "k", "n") == [(1, "a"), (2, None), (3, None)]


def test_fan_out_is_noticed(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(FanOut):
        joins.assert_same_row_count(a, a.union(a), "doubling")


def test_lookup_fails_loud(spark):
    df = spark.createDataFrame([("USD",), ("XXX",), (None,)], "c string")
    with pytest.raises(UnknownKey):
        joins.lookup(df, "c", {"USD": 1.0}, "rate", "double")
    assert rows(joins.lookup(df.where("c <> 'XXX' OR c IS NULL"), "c", {"USD": 1.0}, "rate", "double")) == [("USD", 1.0), (None, None)]


def test_point_in_time_is_half_open(spark):
    h = spark.createDataFrame([("a", 1, 5, "x"), ("a", 5, None, "y")], "k string, valid_from int, valid_to int, v string")
    f = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 5), ("a", 9), ("b", 3)], "k string, t int")
    assert rows(joins.point_in_time_join(f, h, ["k"], "t"), "k", "t", "v") == [("a", 0, None), ("a", 1, "x"), ("a", 4, "x"), ("a", 5, "y"), ("a", 9, "y"), ("b", 3, None)]


def test_containment_loses_what_straddles(spark):
    u = spark.createDataFrame([("r1", "s", 1, 2, 1.0), ("r2", "s", 4, 6, 1.0), ("r3", "s", 7, 8, 1.0)], "r string, k string, a int, b int, q double")
    p = spark.createDataFrame([("s", 0, 5, 2.0), ("s", 5, None, 3.0)], "k string, pa int, pb int, price double")
    assert joins.containment_join(u, p, ["k"], "a", "b", "pa", "pb").count() == 2
    pit = joins.point_in_time_join(u, p, ["k"], "b", "pa", "pb")
    assert rows(joins.coverage(pit, "r", "price")) == [(3, 0, 0)]


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([("a", 0), ("a", 5), ("a", 5), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("a", 5, 3), ("c", 0, 9)], "k string, t int, v int")
    assert rows(joins.asof_join(left, right, ["k"], "t", "t", ["v"]), "k", "t", "t_right", "v") == [("a", 0, None, None), ("a", 5, 5, 3), ("a", 5, 5, 3), ("b", 1, None, None)]


@pytest.mark.parametrize("bucket", [None, 60])
def test_overlap(spark, bucket):
    ts = lambda df: df.withColumns({c: F.col(c).cast("timestamp") for c in ("s", "e")})
    a = ts(spark.createDataFrame([("k", "2026-01-01 00:00:00", "2026-01-01 00:10:00"), ("k", "2026-01-01 01:00:00", "2026-01-01 01:00:30")], "k string, s string, e string"))
    b = ts(spark.createDataFrame([("k", "2026-01-01 00:05:00", "2026-01-01 00:20:00"), ("k", "2026-01-01 00:10:00", "2026-01-01 00:11:00"), ("z", "2026-01-01 00:00:00", "2026-01-01 02:00:00")], "k string, s string, e string"))
    assert joins.overlap_join(a, b, ["k"], "s", "e", bucket).count() == 1


def test_salted_join_keeps_the_result(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 10).alias("k"), "id")
    small = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert rows(joins.salted_join(big, small, ["k"]).select("k", "id", "v")) == rows(big.join(small, "k").select("k", "id", "v"))


def test_salted_join_does_not_broadcast_the_repeated_side(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k", "id % 7 AS v").write.parquet(str(tmp_path / "small"))
    joined = joins.salted_join(spark.range(5000).selectExpr("id % 1000 AS k", "id"), spark.read.parquet(str(tmp_path / "small")), ["k"])
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 5000


def test_null_safe_join(spark):
    t = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    s = spark.createDataFrame([(None, 5)], "k string, w int")
    assert rows(joins.null_safe_join(t, s, "k"), "v", "w") == [(1, 5)]


def test_declared_join_keeps_the_declared_side(spark):
    c = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, name string")
    a = spark.createDataFrame([(1, "Oslo")], "id int, city string")
    got = joins.declared_join({"c": c, "a": a}, "c", [joins.JoinStep("a", {"id": "c_id"})])
    assert got.count() == 3
    with pytest.raises(InvalidSpec):
        joins.declared_join({"c": c}, "c", [joins.JoinStep("nope", {"id": "c_id"})])


def test_sessions_and_streaks(spark):
    c = spark.createDataFrame([("u1", "2026-01-01 10:00:00"), ("u1", "2026-01-01 10:30:00"), ("u1", "2026-01-01 11:00:01"), ("u1", "2026-01-01 11:10:00"), ("u2", "2026-01-01 10:00:00")], "u string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r.session for r in windows.sessionize(c, ["u"], "t", 1800).orderBy("u", "t").collect()] == [1, 1, 2, 2, 1]
    d = spark.createDataFrame([("c", f"2026-09-0{i}") for i in (1, 2, 3, 5, 6)] + [("c", "2026-09-01")], "k string, d string").withColumn("d", F.to_date("d"))
    assert sorted(r.days for r in windows.streaks(d, ["k"], "d").collect()) == [2, 3]


def test_semi_additive_is_not_a_plain_sum(spark):
    b = spark.createDataFrame([("a1", "2026-01-10", 100), ("a1", "2026-01-20", 90), ("a1", "2026-01-31", 80), ("a2", "2026-01-05", 80), ("a2", "2026-01-15", 80)], "a string, d string, v int")
    assert rows(windows.semi_additive(b, ["a"], F.substring("d", 1, 7), "d", "v")) == [("2026-01", 160)]


def test_filter_after_rank(spark):
    h = spark.createDataFrame([("c1", 1, None), ("c1", 2, "deleted"), ("c2", 1, None)], "c string, v int, gone string")
    assert rows(windows.filter_after_rank(h, ["c"], [F.desc("v")], F.col("gone").isNull()), "c") == [("c2",)]


def test_global_rank_is_refused(spark):
    with pytest.raises(InvalidSpec):
        windows.rank_within(spark.range(3), [], [F.col("id")])


def test_rules_fail_on_null_and_split_is_complete(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (None, 1.0), (3, -1.0)], "id int, amount double")
    rules = {"id": "id IS NOT NULL", "amount": "amount >= 0"}
    valid, bad = quality.split_valid(df, rules)
    assert rows(valid, "id") == [(1,)]
    assert sorted((r.id or 0, r.dq_failures) for r in bad.collect()) == [(0, ["id"]), (2, ["amount"]), (3, ["amount"])]
    flags = [r[0] for r in df.select(F.expr(quality.leaky_quarantine(rules))).collect()]
    assert None in flags


def test_ambiguous_rules_and_gates(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert quality.ambiguous_rules(df, {"x": "a > 0", "y": "a IS NOT NULL"}) == ["x"]
    with pytest.raises(AmbiguousRule):
        quality.require_unambiguous(df, {"x": "a > 0"})
    with pytest.raises(QualityGateFailed):
        quality.require_rate(df, F.col("b").isNull(), 0.4, "b")
    with pytest.raises(QualityGateFailed):
        quality.require_steady_nulls(df.where("b IS NOT NULL"), df, ["b"])


def test_contract(spark):
    df = spark.createDataFrame([(1, 2.0)], "order_id int, amt double")
    assert quality.contract_diff("order_id INT, amount DOUBLE", df)["possible_renames"] == [("amount", "amt")]
    with pytest.raises(ContractViolated):
        quality.require_contract("order_id INT, amount DOUBLE", df)


def test_expectations(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "a int")
    kept, counts = quality.expect(df, [quality.Expectation("pos", "a > 0", "drop"), quality.Expectation("set", "a IS NOT NULL")])
    assert rows(kept) == [(1,)] and rows(counts) == [("pos", 2), ("set", 1)]
    flagged, _ = quality.expect(df, [quality.Expectation("pos", "a > 0", "drop")], "flag")
    assert rows(flagged) == [(-1, True), (1, False), (None, True)]
    with pytest.raises(QualityGateFailed):
        quality.expect(df, [quality.Expectation("set", "a IS NOT NULL", "fail")])
    with pytest.raises(InvalidSpec):
        quality.load_rules(spark.createDataFrame([], "table_name string, rule_name string, constraint_sql string"), "t")


def test_scores_abstain_when_the_unknown_could_flip_the_band(spark):
    df = spark.createDataFrame([("a", "pass", "high"), ("a", "unknown", "high"), ("b", "pass", "low"), ("b", "pass", "high")], "g string, outcome string, severity string")
    got = {r.g: r for r in quality.score_outcomes(df, ["g"]).collect()}
    assert (got["a"].score, got["a"].low, got["a"].high, got["a"].band) == (1.0, 0.5, 1.0, "abstain")
    assert got["b"].band == "good"


def test_percent_of_total_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert rows(aggregates.percent_of_total(df, ["k"], "v"), "k", "share") == [("a", 0.5), ("b", 0.5)]
    assert rows(aggregates.duplicate_count(df, ["k", "v"])) == [(3, 2, 1)]


def test_cdc_slots_late_changes_and_ignores_nulls(spark):
    feed = spark.createDataFrame([(1, 10, "a", 1), (1, 30, "c", None), (2, 5, "x", 7)], "k int, seq int, v string, w int")
    first = history.apply_cdc(None, feed, ["k"], "seq", scd=2)
    late = spark.createDataFrame([(1, 20, "b", 2)], "k int, seq int, v string, w int")
    got = rows(history.apply_cdc(first, late, ["k"], "seq", scd=2).where("k = 1"), "v", "__start_at", "__end_at")
    assert got == [("a", 10, 20), ("b", 20, 30), ("c", 30, None)]
    assert rows(history.apply_cdc(None, feed, ["k"], "seq", ignore_null_updates=True).where("k = 1"), "v", "w") == [("c", 1)]


def test_snapshot_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "n")], "k int, v string")
    assert rows(history.snapshot_changes(a, b, ["k"], F.lit(1)), "k", "v", "_op") == [(2, "z", "upsert"), (3, None, "delete"), (4, "n", "upsert")]
