"""Edges of streams, configuration, table lookup, neighbours, updates and ranges."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sedra.functions import resolve, typed
from sedra.operators import ml
from sedra.operators import query as q
from sedra.operators.tableset import Node, counted, fetch
from sedra.plans import config
from sedra.plans.grouping import CONFIG
from sedra.plans.nest import Aggregate, Group, Level, Nest
from sedra.streaming.nests import events_stream, run_to_table


def by_type():
    return Nest((Level((Group("k", resolve.field("k")),), (Aggregate("n", "count"),)),))


@pytest.mark.parametrize("mode", ["complete", "update"])
def test_stream_of_an_empty_folder(spark, tmp_path, mode):
    (tmp_path / "in").mkdir()
    stream = events_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], "k string").schema)
    got = run_to_table(by_type(), stream, f"{tmp_path}/out", f"{tmp_path}/c", mode)
    assert got.columns == ["k", "n"] + ["batch"] * (mode == "update") and got.isEmpty()


def test_replayed_batch_is_stored_once(spark, tmp_path):
    """The same batches again, as after a failure before they were committed."""
    spark.createDataFrame([("a",), ("a",), ("b",)], "k string").coalesce(1).write.parquet(f"{tmp_path}/in")
    for checkpoint in ("c1", "c2"):
        stream = events_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], "k string").schema)
        got = run_to_table(by_type(), stream, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", "update")
    assert {tuple(r) for r in got.collect()} == {("a", 2, 0), ("b", 1, 0)}


def test_all_errors_are_told():
    bad = json.loads(CONFIG)
    level = bad["nestLevels"]
    level["aggregate"][0]["methodName"], level["aggregate"][1]["searchPath"] = "vh_acm_median", {}
    level["groupBy"][0]["prepCol"]["intervalType"], level["groupBy"][1]["colour"] = "eons", 1
    found = config.check(json.dumps(bad))
    assert [x.split(":")[0] for x in found] == ["nestLevels[0].groupBy[0]", "warn", "nestLevels[0].aggregate[0]", "nestLevels[0].aggregate[1]"]
    assert config.check(CONFIG) == []


def test_table_lookup(spark, tmp_path):
    for s in ("low", "high"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {s} LOCATION '{tmp_path}/{s}'")
        spark.sql(f"CREATE TABLE {s}.both USING parquet AS SELECT '{s}' AS s")
    spark.sql("CREATE TABLE high.one USING parquet AS SELECT 1 AS x")
    try:
        assert resolve.table(spark, "both", ["low", "high"]) == "low.both" and resolve.table(spark, "one", ["low", "high"]) == "high.one"
        for name, unique in (("both", True), ("One", False)):
            with pytest.raises(KeyError):
                resolve.table(spark, name, ["low", "high"], unique)
        found = config.table(json.dumps({"methodName": "table", "schemaName": ["low", "high"], "tableName": "one"}))(spark)
        assert spark.table(found).first().x == 1
        with pytest.raises(config.ConfigError):
            config.table(json.dumps({"schemaName": "low"}))
    finally:
        for s in ("low", "high"):
            spark.sql(f"DROP DATABASE {s} CASCADE")


def test_neighbours_of_odd_vectors_and_labels(spark):
    rows = [(0, [0.0, 0.0], 0.5), (1, [1.0, 0.0], 0.75), (2, [0.0, 1.0], 1.0), (3, None, 9.0), (4, [1.0, None], 9.0), (5, [float("nan"), 0.0], 9.0), (6, [0.0], 9.0)]
    train = spark.createDataFrame(rows, "id long, v array<double>, label double")
    test = spark.createDataFrame([(7, [0.1, 0.1]), (8, None), (9, [1.0, 2.0, 3.0])], "id long, v array<double>")
    assert ml.knn_mean(test, train).collect() == [(7, 0.75)]
    named = train.withColumn("label", F.when(F.col("id") < 2, "x").otherwise("y"))
    assert ml.knn_predict(test, named).collect() == [(7, "x")]
    assert ml.neighbours(test, train.limit(0)).count() == 0
    many, one = (ml.neighbours(train, train, 2, block=b, test_block=b) for b in (2, 100))
    assert sorted(many.collect()) == sorted(one.collect())


def test_nearest_by_products_are_those_by_the_plain_formula():
    """Random, equal, far and offset vectors, ties in nine digits, components whose squares overflow; in a time that judging pairs one by one takes many times over."""
    rng = np.random.default_rng(5)
    for scale, offset, digits in ((1.0, 0.0, 16), (1.0, 0.0, 0), (1e-5, 0.0, 16), (1e-6, 1e3, 16), (1e200, 0.0, 16), (0.0, 1.0, 16)):
        q, c = ((rng.standard_normal((n, 5)) * scale + offset).round(digits) for n in (60, 5000))
        c[1000:1100] = c[:100]
        for k in (1, 3, 7000):
            i, j, d = ml._nearest("euclid", q, c, k)
            with np.errstate(over="ignore"):
                want = ml._block_distances("euclid", q, c).round(9)
            top = np.argsort(want, axis=1, kind="stable")[:, :k]
            assert np.array_equal(i, np.repeat(np.arange(60), top.shape[1])) and np.array_equal(j, top.ravel())
            assert np.array_equal(d, np.take_along_axis(want, top, axis=1).ravel())
    assert ml._first_copies(np.array([[1.0], [2.0], [1.0], [1.0], [2.0]]), 2).tolist() == [0, 1, 2, 4]
    q, c = rng.standard_normal((4000, 64)), rng.standard_normal((20000, 64))
    start = time.process_time()
    ml._nearest("euclid", q, c, 3)
    assert time.process_time() - start < 10


def _near_rows(spark, n=4500):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((n, 32)).round(1)
    v[::7] = v[0]
    label = rng.integers(0, 4, n)
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "v": v.tolist(), "label": label}), "id long, v array<double>, label int")
    ask, held = np.arange(0, n, 3), np.flatnonzero(np.arange(n) % 3)
    near = [held[np.argsort(np.sqrt(((v[held] - v[i]) ** 2).sum(axis=1)).round(9), kind="stable")[:3]] for i in ask]
    return rows.where("id % 3 = 0"), rows.where("id % 3 <> 0"), label, dict(zip(ask.tolist(), near))


def test_mean_of_the_nearest_in_several_groups(spark):
    """Many equal vectors, and groups whose nearest are merged; by plain numpy."""
    test, train, label, near = _near_rows(spark)
    found = ml.neighbours(test, train, block=1000, test_block=700).groupBy("id").agg(F.avg("label").alias("m"), F.collect_set("train_id").alias("t"))
    assert {r.id: set(r.t) for r in found.collect()} == {i: set(x.tolist()) for i, x in near.items()}
    assert {r.id: round(r.predicted, 9) for r in ml.knn_mean(test, train).collect()} == {i: round(label[x].mean(), 9) for i, x in near.items()}


def test_accuracy_of_the_nearest(spark):
    """Hits of majority labels, ties to the greatest; by plain numpy."""
    test, train, label, near = _near_rows(spark, 1500)
    top = lambda x: max(range(4), key=lambda c: ((label[x] == c).sum(), c))
    got = ml.accuracy(ml.knn_predict(test, train).join(test, "id"), "label").first().accuracy
    assert abs(got - np.mean([top(x) == label[i] for i, x in near.items()])) < 1e-12


def test_nearest_by_single_precision(monkeypatch):
    """Pairs are judged in single precision, and in double only where single can't tell vectors apart or overflows."""
    kinds, within = set(), ml._within
    monkeypatch.setattr(ml, "_within", lambda scores, bound: kinds.add(scores.dtype.name) or within(scores, bound))
    rng = np.random.default_rng(7)
    for scale, offset, used in ((1.0, 0.0, {"float32"}), (1e-3, 1e3, {"float32", "float64"}), (1e-9, 1.0, {"float32", "float64"}), (1e18, 0.0, {"float64"})):
        q, c = (rng.standard_normal((n, 6)) * scale + offset for n in (700, 5000))
        kinds.clear()
        i, j, d = ml._nearest("euclid", q, c, 4)
        want = ml._block_distances("euclid", q, c).round(9)
        top = np.argsort(want, axis=1, kind="stable")[:, :4]
        assert kinds == used
        assert np.array_equal(i, np.repeat(np.arange(700), 4)) and np.array_equal(j, top.ravel())
        assert np.array_equal(d, np.take_along_axis(want, top, axis=1).ravel())


def test_nearest_among_near_copies(monkeypatch):
    """Groups of near copies: only the rows in them go on in double, and few of their pairs are left to the plain formula."""
    judged, seen, plain, within = [], [], ml._plain, ml._within
    monkeypatch.setattr(ml, "_plain", lambda q, c, i, j: judged.append(len(i)) or plain(q, c, i, j))
    monkeypatch.setattr(ml, "_within", lambda scores, bound: seen.append((scores.dtype.name, len(scores))) or within(scores, bound))
    rng = np.random.default_rng(8)
    for groups, share in ((1, 0.2), (16, 1.0), (16, 0.5)):
        middle = rng.standard_normal((groups, 64))
        q, c = (rng.standard_normal((n, 64)) for n in (600, 6000))
        for v in (q, c):
            some = rng.random(len(v)) < share
            v[some] = middle[rng.integers(0, groups, some.sum())] + 1e-3 * v[some]
        judged.clear()
        seen.clear()
        i, j, d = ml._nearest("euclid", q, c, 3)
        want = np.concatenate([ml._block_distances("euclid", q[x : x + 50], c) for x in range(0, 600, 50)]).round(9)
        top = np.argsort(want, axis=1, kind="stable")[:, :3]
        assert np.array_equal(i, np.repeat(np.arange(600), 3)) and np.array_equal(j, top.ravel())
        assert np.array_equal(d, np.take_along_axis(want, top, axis=1).ravel())
        assert sum(judged) < 20 * len(q)
        assert max(n for kind, n in seen if kind == "float64") <= 512 * min(1.0, share * 1.2)


def test_blocks_of_neighbours_keep_cores_busy():
    assert ml._blocks(0, 0, 32768, 32768, 12) == (1, 1)
    assert ml._blocks(3_419, 6_837, 32768, 32768, 12) == (1, 1)
    for n in (17_000, 34_000, 205_000, 2_000_000):
        a, b = ml._blocks(n, 2 * n, 32768, 32768, 12)
        assert n / a <= 32768 and 2 * n / b <= 32768 and a * b >= min(24, (2 * n * n) >> 25)
    assert ml._blocks(205_000, 410_000, 32768, 32768, 12) == (7, 13)


def test_accuracy_of_labels_beyond_a_double(spark):
    """Labels keep their value, for the step's groups hold rows without one."""
    big = 2**60
    rows = spark.createDataFrame([(i, [float(i // 3), 0.0], big + i // 3) for i in range(30)], "id long, v array<float>, label long")
    test, train = rows.where("id % 3 = 0"), rows.where("id % 3 <> 0")
    got = ml.knn_predict(test, train, 2)
    assert {r.id: r.predicted for r in got.collect()} == {i: big + i // 3 for i in range(0, 30, 3)}
    assert ml.accuracy(got.join(test, "id"), "label").first().accuracy == 1.0
    mixed = ml.neighbours(test, train.withColumn("v", F.col("v").cast("array<double>")), 2, block=5, test_block=4)
    assert sorted((r.id, r.train_id, r.label) for r in mixed.collect()) == [(i, i + x, big + i // 3) for i in range(0, 30, 3) for x in (1, 2)]


def test_update_to_null(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "k int, v string, w int")
    changes = spark.createDataFrame([(1, None, 9, ["v"]), (2, None, 5, ["w", "v"]), (None, "z", 0, ["v"])], "k int, v string, w int, fields array<string>")
    assert {tuple(r) for r in q.updated(t, changes, ["k"], "fields").collect()} == {(1, None, 1), (2, None, 5), (None, "n", 3)}


def test_wide_and_narrow_ranges_join(spark):
    a = spark.createDataFrame([(1, 0.0, 1e9), (2, 5.0, 5.5), (3, -1e6, 6.0), (4, 7.0, 7.0)], "i int, lo double, hi double")
    b = spark.createDataFrame([(x,) for x in (-2e6, -1e6, 0.0, 5.25, 6.0, 7.0, 1e9)], "x double")
    got = q.range_join(a, b, 0.5, "lo", "hi", "x")
    assert {(r.i, r.x) for r in got.collect()} == {(r.i, r.x) for r in a.join(b, (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).collect()}
    assert q.range_join(a.limit(0), b, 0.5, "lo", "hi", "x").count() == 0


def test_ranges_are_counted_without_pairs(spark):
    """Repeated keys, equal, reversed and null bounds, values that are null or not finite, in one part and in many; 10^10 pairs are none too many."""
    inf, nan = float("inf"), float("nan")
    points = [0.0, -0.0, 1.0, 1.0, 2.5, inf, -inf, nan, None] + [float(x % 40) for x in range(200)]
    ranges = [(1, 0.0, 1.0), (1, 1.0, 2.5), (2, 1.0, 1.0), (3, 5.0, 1.0), (4, -inf, inf), (5, 3.5, nan), (6, None, 1.0), (7, 1e6, 2e6), (None, 2.0, 30.25), (8, -0.0, 0.5), (9, nan, nan)]
    a = spark.createDataFrame(ranges, "k int, lo double, hi double")
    b = spark.createDataFrame([(x,) for x in points], "x double")
    want = {tuple(r) for r in a.join(b, (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).groupBy("k").count().collect()}
    for part_rows in (1 << 16, 5, 1):
        got = [tuple(r) for r in q.range_counts(a, b, ["k"], "lo", "hi", "x", part_rows).collect()]
        assert len(got) == len(want) and set(got) == want
    assert q.range_counts(a.limit(0), b, ["k"], "lo", "hi", "x").isEmpty() and q.range_counts(a, b.limit(0), ["k"], "lo", "hi", "x").isEmpty()
    many = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("lo"), F.lit(1000).alias("hi"))
    assert q.range_counts(many, spark.range(100_000).selectExpr("id % 1000 AS x"), ["k"], "lo", "hi", "x").agg(F.sum("n")).first()[0] == sum(100_000 - 100 * (k % 7) for k in range(100_000))


def test_counts_equal_the_fetched_tree(spark):
    c = spark.createDataFrame([(10, 1), (11, 1), (12, None)], "c int, fk int")
    g = spark.createDataFrame([(100, 10), (101, 10), (102, 12)], "g int, fc int")
    tree = Node("roots", spark.createDataFrame([(1,), (2,)], "p int"), (), (Node("kids", c, (("p", "fk"),), (Node("grand", g, (("c", "fc"),)),)),))
    assert {tuple(r) for r in counted(tree).collect()} == {(1, 2, 2), (2, 0, 0)}
    assert {r.p: len(r.kids) for r in fetch(tree).collect()} == {1: 2, 2: 0}


def test_operators(spark):
    ops, one = typed.Operators(), spark.range(1)
    value = lambda c: one.select(c.alias("r")).first().r
    assert value(ops.apply("int", "%", "int", F.lit(-7), F.lit(3))) == -1
    assert value(ops.assign("smallint", "++", "smallint", F.lit(37).cast("smallint"), None)) == 38
    with pytest.raises(KeyError):
        ops.apply("int", "^", "int", F.lit(1), F.lit(1))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|REMAINDER_BY_ZERO"):
        value(ops.apply("int", "%", "int", F.lit(1), F.lit(0)))


def test_bounds(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("r")).first().r
    r = typed.bounded(F.lit(3), F.lit(9), "int", typed.UPPER_INCLUSIVE)
    assert tuple(value(r)) == (4, 10) and value(typed.range_size(r, "int")) == 6
    assert value(typed.range_size(typed.bounded(F.lit(None), F.lit(9), "int"), "int")) is None
    days = typed.bounded(F.lit("2016-05-28"), F.lit("2016-12-31"), "date", 0)
    assert [str(x) for x in value(days)] == ["2016-05-29", "2016-12-31"]
