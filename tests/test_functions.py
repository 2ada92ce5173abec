"""Parsers, keys, hashes, NULL-safe predicates, time zones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.errors import UnknownColumn, error_class
from millrace.operators import projections


def one(spark, rows, kind, expr):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, v {kind}").orderBy("i").select(expr(F.col("v"))).collect()]


def test_timestamps_parse_in_four_formats_and_else_are_null(spark):
    rows = ["2026-01-02T03:04:05Z", "2026-01-02 03:04:05", "01/02/2026 03:04", "1767322800000", "17673228000", "soon", None]
    got = one(spark, rows, "string", lambda c: F.date_format(fn.parse_timestamp(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2026-01-02 03:04:05", "2026-01-02 03:04:05", "2026-01-02 03:04:00", "2026-01-02 03:00:00", None, None, None]


def test_amounts(spark):
    got = one(spark, ["$1,234.50", " 7 ", "abc", None, "1.005"], "string", lambda c: fn.parse_amount(c).cast("string"))
    assert got == ["1234.50", "7.00", None, None, "1.01"]


def test_customer_ids_and_uuids(spark):
    assert one(spark, ["c-7", "7", " C00007", "00007", "C7", "x7", "1234567"], "string", fn.normalize_customer_id) == ["C00007"] * 5 + [None, None]
    u = "550e8400-e29b-41d4-a716-446655440000"
    assert one(spark, [u.upper(), "{" + u.replace("-", "") + "}", u[:-1]], "string", fn.canonical_uuid) == [u, u, None]


def test_long_customer_keys_have_no_id(spark, tmp_path):
    from millrace import catalog

    spark.createDataFrame([(k,) for k in (12, 99_997, 100_000, 100_001, 100_002, 1_234_567)], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.c_custkey: r.id for r in catalog.QUERIES["str06_normalize_customer_id"](spark, str(tmp_path)).collect()}
    assert got == {12: "C00012", 99_997: "C99997", 100_000: None, 100_001: None, 100_002: None, 1_234_567: None}


def test_would_round(spark):
    assert one(spark, ["1.12", "1.125"], "string", fn.would_round) == [False, True]


def test_row_hash_tells_null_places_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    h = [r[0] for r in df.select(fn.row_hash("x", "y")).collect()]
    assert h[0] == h[2] != h[1]


def test_null_predicates(spark):
    rows = ["A", "B", None]
    assert one(spark, rows, "string", lambda c: fn.null_safe_not_equal(c, "A")) == [False, True, True]
    assert one(spark, rows, "string", lambda c: fn.flag_excluded(c == "A", c == "Z")) == [False, True, True]
    assert one(spark, rows, "string", lambda c: fn.optional_filter(c, "A,B")) == [True, True, False]
    assert one(spark, rows, "string", lambda c: fn.optional_filter(c, "")) == [True] * 3


def test_vocabulary_fingerprint_slug_region(spark):
    assert one(spark, [" Canceled ", "PAID"], "string", lambda c: fn.map_vocabulary(c, {"canceled": "cancelled"})) == ["cancelled", "paid"]
    a, b, c = one(spark, ["select 1 from t", "SELECT  2 FROM t", "select 1 from u"], "string", fn.query_fingerprint)
    assert a == b != c
    assert one(spark, ["Hello, World! v2"], "string", fn.slug) == ["hello-world-v2"]
    assert one(spark, ["PREMIUM_JOBS_US_EAST_N", "STORAGE"], "string", fn.region_from_sku) == ["US_EAST_N", None]


def test_time_zones(spark):
    days = [dt.date(2026, 3, 8), dt.date(2026, 7, 1), dt.date(2026, 11, 1)]
    assert one(spark, days, "date", lambda c: fn.day_hours(c, "America/New_York")) == [23.0, 24.0, 25.0]
    assert one(spark, ["2026-07-01 03:00:00"], "string", lambda c: fn.local_date(c.cast("timestamp"), "America/New_York")) == [dt.date(2026, 6, 30)]
    both = one(spark, ["2026-07-01 12:00:00"], "string", lambda c: F.hour(fn.fixed_offset_time(c.cast("timestamp"), "-05:00")) - F.hour(fn.local_time(c.cast("timestamp"), "America/New_York")))
    assert both == [-1]


def test_similar_columns_are_never_substituted(spark):
    df = spark.createDataFrame([(1, "a")], "customer_id int, name string")
    with pytest.raises(UnknownColumn):
        projections.resolve_column(df, "customerid")
    with pytest.raises(UnknownColumn):
        projections.rename(df, {"nmae": "title"})


def test_error_classes(spark):
    for sql, want in [("SELECT cast('x' AS INT)", "CAST_INVALID_INPUT"), ("SELECT 1/0", "DIVIDE_BY_ZERO"), ("SELECT nope FROM VALUES (1) AS t(a)", "UNRESOLVED_COLUMN"), ("SELECT * FROM no_such_table", "TABLE_OR_VIEW_NOT_FOUND")]:
        with pytest.raises(Exception) as caught:
            spark.sql(sql).collect()
        assert error_class(caught.value).startswith(want)


def test_ambiguous_and_coerced_keys(spark):
    from millrace import plans

    a, b = spark.createDataFrame([("007", 1)], "k string, v int"), spark.createDataFrame([(7, 2)], "k bigint, w int")
    joined = a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k"))
    assert joined.count() == 1  # text is cast to the other side's type
    with pytest.raises(Exception) as caught:
        joined.select("k").collect()
    assert error_class(caught.value).startswith("AMBIGUOUS_REFERENCE")
    with pytest.raises(Exception) as caught:
        spark.sql("SELECT 'N/A' = cast(id AS BIGINT) AS same FROM range(1)").collect()
    assert error_class(caught.value).startswith("CAST_INVALID_INPUT")
    with plans.ansi_off(spark):
        assert spark.sql("SELECT 'N/A' = cast(id AS BIGINT) AS same FROM range(1)").first()[0] is None
