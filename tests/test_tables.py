"""Versioned tables, merges, SCD2, incremental loads, the orders pipeline."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace import errors as E
from millrace.operators import history, incremental
from millrace.plans.lake import ORDERS, Lake
from millrace.sources import read_inferred
from millrace.table import VersionedTable


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable.create(spark, f"{tmp_path}/t", "id INT, v STRING, n INT", not_null=["id"], checks={"positive": "n > 0"}, key=["id"])
    t.append(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, n int"))
    return t


def frame(spark, *data):
    return spark.createDataFrame(list(data), "id int, v string, n int")


def test_snapshots_are_pinned_and_read_latest_is_not(spark, table):
    pinned, latest = table.read(), table.read_latest()
    table.append(frame(spark, (3, "c", 3)))
    assert pinned.count() == 2 and latest().count() == 3 and table.read(version=1).count() == 2
    with pytest.raises(E.VersionNotFound):
        table.read(version=9)
    assert [r.operation for r in table.history(1).collect()] == ["APPEND"]


def test_overwrite_may_read_the_table(table):
    table.overwrite(table.read().where("id = 1"))
    assert rows(table.read(), "id") == [(1,)]


def test_constraints_are_three_different_failures(spark, table):
    before = table.version()
    with pytest.raises(E.CheckViolated):
        table.append(frame(spark, (3, "c", 0)))
    with pytest.raises(E.CheckViolated):  # NULL isn't true
        table.append(frame(spark, (3, "c", None)))
    with pytest.raises(E.NotNullViolated):
        table.append(frame(spark, (None, "c", 1)))
    with pytest.raises(E.MissingNotNullColumn):
        table.append(spark.createDataFrame([("c", 1)], "v string, n int"))
    assert table.version() == before


def test_schema_enforcement_and_evolution(spark, tmp_path):
    t = VersionedTable.create_from(spark.createDataFrame([(1, 2.0)], "id int, amount double"), f"{tmp_path}/e")
    more = spark.createDataFrame([(2, 3.0)], "id int, amt double")
    with pytest.raises(E.SchemaMismatch):
        t.append(more)
    t.append(more, merge_schema=True)
    assert rows(t.read()) == [(1, 2.0, None), (2, None, 3.0)]
    with pytest.raises(E.SchemaMismatch):
        t.append(spark.createDataFrame([("x",)], "id string"))
    with pytest.raises(E.DuplicateColumns):
        t.append(spark.range(1).select(F.lit(1).alias("id"), F.lit(2).alias("id")))


def test_merge_rules(spark, table):
    with pytest.raises(E.MultipleSourceRowsMatched):
        table.merge(frame(spark, (1, "x", 1), (1, "y", 1)), ["id"], update="*", insert="*")
    table.merge(frame(spark, (9, "x", 1), (9, "y", 1)), ["id"], update="*", insert="*")  # repeats among new keys are no conflict
    assert table.read().where("id = 9").count() == 2
    table.merge(frame(spark, (1, "z", 5), (7, "q", 1), (7, "r", 1)), ["id"], insert="*")
    assert rows(table.read().where("id in (1, 7)"), "id", "v") == [(1, "a"), (7, "q"), (7, "r")]


def test_sequenced_upsert_keeps_the_target_on_ties(spark, tmp_path):
    t = VersionedTable.create_from(spark.createDataFrame([(1, "old", 5)], "id int, v string, seq int"), f"{tmp_path}/s")
    t.upsert_sequenced(spark.createDataFrame([(1, "tie", 5), (2, "new", 1)], "id int, v string, seq int"), ["id"], "seq")
    t.upsert_sequenced(spark.createDataFrame([(1, "late", 4), (2, "newer", 2)], "id int, v string, seq int"), ["id"], "seq")
    assert rows(t.read(), "id", "v") == [(1, "old"), (2, "newer")]


def test_merge_rewrites_only_touched_files(spark, tmp_path):
    t = VersionedTable.create_from(spark.range(4).select(F.col("id").alias("k"), F.lit("a").alias("v")).repartitionByRange(4, "k"), f"{tmp_path}/f")
    before = set(t.state()["files"])
    t.merge(spark.createDataFrame([(0, "b")], "k bigint, v string"), ["k"], update="*", insert="*")
    assert len(before & set(t.state()["files"])) >= len(before) - 2
    assert rows(t.read().where("v = 'b'"), "k") == [(0,)]


def test_tokens_races_and_streams(spark, table):
    assert table.append(frame(spark, (3, "c", 3)), txn=("app", 1)) is not None
    assert table.append(frame(spark, (3, "c", 3)), txn=("app", 1)) is None
    state = table.state()
    table._commit(table.version(), "TEST", state, [], {}, {})
    with pytest.raises(E.ConcurrentWrite):
        table._commit(table.version() - 1, "TEST", state, [], {}, {})
    table.read_stream()
    table.delete("id = 1")
    with pytest.raises(E.NotAppendOnly):
        table.read_stream()


def test_replace_where_change_feed_and_upkeep(spark, tmp_path):
    t = VersionedTable.create_from(spark.createDataFrame([("a", 1), ("b", 2)], "p string, n int"), f"{tmp_path}/r", partition_by=["p"], key=["p"])
    t.replace_where(spark.createDataFrame([("a", 9)], "p string, n int"), "p = 'a'")
    assert rows(t.read()) == [("a", 9), ("b", 2)] and rows(t.read(partitions={"p": ["b"]})) == [("b", 2)]
    with pytest.raises(E.CheckViolated):
        t.replace_where(spark.createDataFrame([("c", 9)], "p string, n int"), "p = 'a'")
    assert rows(t.changes(1), "n", "_change_type") == [(1, "update_preimage"), (9, "update_postimage")]
    t.optimize()
    assert t.vacuum() > 0 and rows(t.read()) == [("a", 9), ("b", 2)]


def test_long_logs_are_read_from_checkpoints(spark, tmp_path):
    t = VersionedTable.create_from(spark.range(1), f"{tmp_path}/l")
    state = t.state()
    for _ in range(25):
        t._commit(t.version(), "TEST", t.state(), [], {}, {})
    assert t.read().count() == 1 and t.state()["files"] == state["files"]


TS = lambda s: dt.datetime.fromisoformat(s)


def scd2(spark, *data):
    return spark.createDataFrame([(k, n, c, s, TS(t)) for k, n, c, s, t in data], "customer_id string, name string, city string, segment string, effective_ts timestamp")


def test_scd2_chains_noops_late_events_and_reruns(spark, tmp_path):
    keys, tracked, at = ["customer_id"], ["name", "city", "segment"], "effective_ts"
    b1 = scd2(spark, ("C1", "Ann", "Austin", "SMB", "2026-01-01"), ("C2", "Bob", "Boston", "SMB", "2026-01-01"))
    t = VersionedTable.create_from(history.build_scd2(b1, keys, tracked, at), f"{tmp_path}/d")
    b2 = scd2(spark, ("C1", "Ann", "Denver", "SMB", "2026-02-01"), ("C1", "Ann", "Seattle", "Ent", "2026-03-01"), ("C2", "Bob", "Boston", "SMB", "2026-02-01"), ("C3", "Cy", "Reno", "SMB", "2026-02-01"))
    assert history.upsert_scd2(t, b2, keys, tracked, at).count() == 0
    got = rows(t.read(), "customer_id", "city", "is_current")
    assert got == [("C1", "Austin", False), ("C1", "Denver", False), ("C1", "Seattle", True), ("C2", "Boston", True), ("C3", "Reno", True)]
    assert history.upsert_scd2(t, b2, keys, tracked, at).count() == 3  # a rerun: only the no-op isn't at or before a current version
    assert rows(t.read(), "customer_id", "city", "is_current") == got
    late = history.upsert_scd2(t, scd2(spark, ("C2", "Bobby", "Boston", "SMB", "2025-12-01")), keys, tracked, at)
    assert rows(late, "customer_id", "name") == [("C2", "Bobby")]
    from millrace.operators.quality import scd2_violations
    assert {r.violations for r in scd2_violations(t.read(), keys).collect()} == {0}
    with pytest.raises(E.MultipleSourceRowsMatched):
        history.naive_scd2(t, scd2(spark, ("C3", "Cy", "A", "SMB", "2026-05-01"), ("C3", "Cy", "B", "SMB", "2026-06-01")), keys, tracked, at)


def test_watermark_overlap_catches_ties_and_late_commits(spark, tmp_path):
    target = VersionedTable.create(spark, f"{tmp_path}/t", "id INT, updated_at TIMESTAMP")
    marks = VersionedTable.create(spark, f"{tmp_path}/m", "name STRING, watermark TIMESTAMP")
    src = lambda *x: spark.createDataFrame([(i, TS(t)) for i, t in x], "id int, updated_at timestamp")
    first = [(1, "2026-01-01 10:00:00"), (2, "2026-01-01 11:00:00")]
    later = [*first, (3, "2026-01-01 11:00:00"), (4, "2026-01-01 10:59:00"), (5, "2026-01-01 12:00:00")]
    run = lambda data: incremental.run_incremental(src(*data), target, marks, "s", ["id"], "updated_at", 600)
    run(first)
    assert run(later) == 4
    assert rows(target.read(), "id") == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(incremental.since_watermark(src(*later), "updated_at", TS("2026-01-01 11:00:00")).where("updated_at > '2026-01-01 11:00:00'"), "id") == [(5,)]


RAW = [
    {"o_orderkey": " 1 ", "o_custkey": "7", "o_orderstatus": "Open", "o_totalprice": "$1,000.50", "o_orderdate": "2024-01-01", "changed": "1"},
    {"o_orderkey": "2", "o_custkey": "8", "o_orderstatus": "f", "o_totalprice": "10", "o_orderdate": "31.01.2024", "changed": "1"},
    {"o_orderkey": "3", "o_custkey": "9", "o_orderstatus": "pending", "o_totalprice": "20", "o_orderdate": "2024-01-02", "changed": "5"},
    {"o_orderkey": "4", "o_custkey": "7", "o_orderstatus": "O", "o_totalprice": "abc", "o_orderdate": "2024-01-02", "changed": "1"},
    {"o_orderkey": "5", "o_custkey": None, "o_orderstatus": "lost", "o_totalprice": "5", "o_orderdate": "never", "changed": "1"},
]


def test_a_lake_loads_files_once_and_keeps_the_newest_valid_rows(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text("\n".join(map(json.dumps, RAW)) + '\n{"o_orderkey": "6", "o_cust\n')
    b.write_text(json.dumps({**RAW[0], "o_orderstatus": "finished", "changed": "2"}) + "\n" + json.dumps({**RAW[1], "o_totalprice": "-1", "changed": "2"}) + "\n" + json.dumps({**RAW[2], "o_orderstatus": "O", "changed": "4"}) + "\n")
    lake = Lake(spark, str(tmp_path / "lake"), ORDERS)
    one = lake.load([str(a)])
    assert (one.files, one.valid, one.refused) == (["a.json"], 3, 3)
    assert lake.load([str(a), str(b)]).files == ["b.json"]
    again = Lake(spark, str(tmp_path / "lake"), ORDERS).load([str(a), str(b)])
    assert (again.files, again.valid, again.refused) == ([], 0, 0)
    assert lake.landed.read().count() == 9 and lake.landed.read().where("_corrupt_record IS NOT NULL").count() == 1
    assert rows(lake.current.read(), "o_orderkey", "o_orderstatus", "o_totalprice") == [(1, "F", Decimal("1000.50")), (2, "F", Decimal("10.00")), (3, "P", Decimal("20.00"))]
    refused = {r.o_orderkey: r for r in lake.refused.read().collect()}
    assert refused[5].dq_failures == ["has_customer", "state_is_known", "dated"] and refused[5].raw_o_orderdate == "never" and refused[4].dq_failures == refused[2].dq_failures == ["worth_something"]


def test_inference_takes_one_odd_value_for_text(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"amount": 1}\n{"amount": "N/A"}\n')
    assert read_inferred(spark, str(p)).schema["amount"].dataType.simpleString() == "string"


def test_files_without_rows_are_loaded_once(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text('{"o_orderkey": "1", "o_custkey": "1", "o_orderstatus": "O", "o_totalprice": "5", "o_orderdate": "2020-01-01", "changed": "1"}\n')
    (tmp_path / "c.json").write_text("\n\n")
    a, b, c = (str(tmp_path / f"{x}.json") for x in "abc")
    lake = Lake(spark, str(tmp_path / "lake"), ORDERS)
    runs = [lake.load(given) for given in ([a, b], [a, b], [a, b, c], [a, b, c])]
    assert [(r.files, r.valid, r.refused) for r in runs] == [(["a.json", "b.json"], 1, 0), ([], 0, 0), (["c.json"], 0, 0), ([], 0, 0)]
    assert lake.landed.read().count() == lake.current.read().count() == 1 and lake.landed.state()["rowless"] == ["a.json", "c.json"]
