"""Integer variances where sums of squares overflow, own accumulators, exact roots."""

import random

import pytest
from pyspark.sql import functions as F

from sedra.functions import aggregates as agg
from sedra.functions.resolve import field
from sedra.plans.nest import Aggregate, Group, Level, Nest


def by_hand(values, less):
    n = len(values)
    return (n * sum(v * v for v in values) - sum(values) ** 2) // (n * (n - less)) if n > less else 0


def test_integer_variance_by_hand(spark):
    rng = random.Random(3)
    groups = [[rng.randint(-(10**w), 10**w) for _ in range(rng.randint(1, 30))] for w in (0, 1, 3, 9) for _ in range(12)]
    groups += [[base + rng.randint(-(10**6), 10**6) for _ in range(200)] for base in (2**62, -(2**62), 2**63 - 10**6 - 1, 1_700_000_000_000_000)]
    df = spark.createDataFrame([(i, v) for i, g in enumerate(groups) for v in g], "g int, v bigint")
    got = df.groupBy("g").agg(*[agg.accumulate(m, F.col("v"), True).alias(m) for m in ("avg", "varp", "vars", "devp")]).collect()
    for r in got:
        g = groups[r.g]
        assert (r.varp, r.vars) == (by_hand(g, 0), by_hand(g, 1))
        assert r.devp**2 <= r.varp < (r.devp + 1) ** 2 and r.avg == int(abs(sum(g)) // len(g)) * (1 if sum(g) > 0 else -1)


def test_variance_of_many_rows(spark):
    """Ten million microsecond times; their squares are far beyond 38 digits when summed and multiplied."""
    df = spark.range(10_000_000).select((F.col("id") * 1000 + 1_700_000_000_000_000).alias("v"))
    n = 10_000_000
    assert df.agg(agg.accumulate("varp", F.col("v"), True).alias("r")).first().r == 10**6 * (n * n - 1) // 12


def test_too_large_a_variance_raises(spark):
    df = spark.createDataFrame([(2**62,), (-(2**62),)], "v bigint")
    with pytest.raises(Exception, match="OVERFLOW|OUT_OF_RANGE"):
        df.agg(agg.accumulate("varp", F.col("v"), True)).collect()


def test_integer_root(spark):
    values = [0, 1, 3, 4, 2**53 + 1, 3037000499**2, 3037000499**2 - 1, 2**63 - 1]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", agg.integer_root(F.col("v")).alias("r")).collect()
    assert all(r.r**2 <= r.v < (r.r + 1) ** 2 for r in got)


def test_own_accumulator(spark):
    agg.register("width_of_test", lambda c: F.max(c) - F.min(c))
    df = spark.createDataFrame([("a", 3), ("a", 10), ("b", 4)], "k string, v int")
    nest = Nest((Level((Group("k", field("k")),), (Aggregate("w", "width_of_test", field("v")),)),))
    assert {tuple(r) for r in nest.frame(df).collect()} == {("a", 7), ("b", 0)}
    with pytest.raises(ValueError):
        agg.register("avg", F.avg)
