"""Known values of accumulators, transforms, typed operators and ranges."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedra.functions import transforms as t
from sedra.functions import typed
from sedra.functions.aggregates import METHODS, accumulate


def agg(spark, values, kind, method):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return df.agg(accumulate(method, F.col("v"), kind != "double").alias("r")).first().r


@pytest.mark.parametrize(
    "values, kind, method, want",
    [
        ([10] * 5 + [50], "short", "avg", 16), ([10] * 5 + [50], "short", "count", 6), ([100, 50, 25], "short", "max", 100), ([100, 50, 25, 30, 100, 101], "short", "max", 101),
        ([100, 50, 25], "short", "min", 25), ([15, 15, -10], "short", "sum", 20), ([10, 20, 30, 80, 50, 60, 75, 72, 76], "int", "vars", 703),
        ([72, 75, 78, 69, 70, 81], "int", "avg", 74), ([72, 75, 78, 69, 70, 81], "int", "varp", 18), ([72, 75, 78, 69, 70, 81], "int", "devp", 4),
        ([7], "int", "vars", 0), ([7.0], "double", "devs", 0.0), ([], "int", "avg", 0), ([], "double", "avg", 0.0), ([], "int", "min", None),
        ([1, None, 3], "int", "avg", 2), ([1, None, 3], "int", "count", 3), ([-5, 0], "int", "avg", -2), ([2**40, 2**40 + 2], "bigint", "varp", 1),
    ],
)
def test_accumulators(spark, values, kind, method, want):
    assert agg(spark, values, kind, method) == want


TS = "2017-03-21 12:37:07"


@pytest.mark.parametrize(
    "n, unit, lower, want",
    [(10, "seconds", True, "12:37:00"), (10, "seconds", False, "12:37:10"), (60, "seconds", True, "12:37:00"), (60, "seconds", False, "12:38:00"), (1, "minutes", True, "12:37:00"), (1, "minutes", False, "12:38:00"), (1, "hours", True, "12:00:00"), (1, "hours", False, "13:00:00")],
)
def test_time_buckets(spark, n, unit, lower, want):
    got = spark.range(1).select(t.time_bucket(F.lit(TS).cast("timestamp_ntz"), n, unit, lower).alias("b")).first().b
    assert got == dt.datetime.fromisoformat(f"2017-03-21 {want}")


@settings(max_examples=15, deadline=None)
@given(st.datetimes(dt.datetime(1950, 1, 1), dt.datetime(2050, 1, 1)), st.integers(1, 90), st.sampled_from(sorted(t.MICROS)))
def test_bucket_bounds(spark, ts, n, unit):
    c = F.lit(ts).cast("timestamp_ntz")
    low, high = spark.range(1).select(t.time_bucket(c, n, unit, True), t.time_bucket(c, n, unit, False)).first()
    assert low <= ts < high and high - low == dt.timedelta(microseconds=n * t.MICROS[unit])


@pytest.mark.parametrize("day, jdn", [("1970-01-01", 2440588), ("1987-07-18", 2446995), ("2016-02-29", 2457448), ("2000-01-01", 2451545)])
def test_julian_days(spark, day, jdn):
    c = typed.julian_day(F.lit(day))
    assert spark.range(1).select(c, typed.from_julian_day(c)).first()[:] == (jdn, dt.date.fromisoformat(day))


def test_typed_arithmetic(spark):
    a, b = F.lit(12).cast("smallint"), F.lit(3).cast("smallint")
    out = spark.range(1).select(*[typed.arith(a, op, b, "smallint").alias(op) for op in "+-*/"])
    assert out.first()[:] == (15, 9, 36, 4) and {x.dataType.simpleString() for x in out.schema} == {"smallint"}
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        spark.range(1).select(typed.arith(F.col("id"), "/", F.lit(0), "bigint")).collect()
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.range(1).select(typed.arith(F.lit(32767), "+", F.lit(1), "smallint")).collect()
    ops = typed.Operators()
    ops.register("int", "max", "int", F.greatest)
    assert spark.range(1).select(ops.apply("int", "max", "int", F.lit(3), F.lit(8)), ops.apply("int", "*", "int", F.lit(3), F.lit(8))).first()[:] == (8, 24)


def test_ranges(spark):
    d = lambda x: F.lit(x).cast("date")
    r = lambda a, b, flags=1: typed.date_range(d(a), d(b), flags)
    open_, half = r("2016-05-28", "2016-12-31", 0), r("2016-05-29", "2016-12-31")
    assert spark.range(1).select(open_).first()[0][:] == (dt.date(2016, 5, 29), dt.date(2016, 12, 31))
    checks = [typed.range_contains(half, open_), typed.range_contained(open_, half), typed.range_overlaps(half, r("2016-12-30", "2017-02-01")), ~typed.range_overlaps(half, r("2016-12-31", "2017-02-01")), typed.range_adjacent(half, r("2016-12-31", "2017-02-01")), typed.range_contains(r(None, None), half), ~typed.range_contains(half, r(None, None))]
    assert all(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(checks)]).first())


def test_transforms(spark):
    df = spark.createDataFrame([(1, None), (2, 7)], "id int, v int")
    got = df.select(t.default_value(F.col("v"), 500).alias("a"), t.default_value(F.col("v"), 500, True).alias("b"), t.min_max(F.col("id"), 1, 3).alias("c"), t.min_max(F.col("id"), 2, 2).alias("d"), t.sequence([F.col("id")], 10).alias("e")).orderBy("e").collect()
    assert [tuple(r) for r in got] == [(500, 500, 0.0, None, 10), (500, 7, 0.5, None, 11)]
    assert set(METHODS) >= {"count", "avg"}
