"""Nests, configuration, streams, builders, stores, and every query against its SQL."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sedra.functions import resolve
from sedra.operators import ml
from sedra.operators import query as q
from sedra.operators.tableset import Node, fetch
from sedra.plans import config, registry
from sedra.plans.grouping import CONFIG, bucket_nest
from sedra.plans.nest import Aggregate, Group, Level, Nest
from sedra.plans.schema import Schema, TableSpec
from sedra.sources.store import Store, printed, sql
from sedra.streaming.nests import events_stream, run_to_table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_query_against_sql(spark):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    queries, twins = registry.queries(), registry.oracle_sql()
    assert set(queries) == set(twins)
    for name, run in queries.items():
        df = run(spark, folder)
        want = con.sql(f"select {', '.join(df.columns)} from ({twins[name]})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)), name


@pytest.fixture
def sensor(spark):
    times = [dt.datetime(2017, 3, 27, 15, 58, 3)] * 6
    return spark.createDataFrame([(x, 1, v) for x, v in zip(times, (72, 75, 78, 69, 70, 81))], "time timestamp_ntz, sensorid short, temperature int")


def test_sensor_nest(sensor):
    from sedra.functions import transforms as t

    value = resolve.field("temperature")
    level = Level((Group("minute", lambda df: t.time_bucket(F.col("time"), 1, "minutes", False)), Group("sensorid", resolve.field("sensorid"))), tuple(Aggregate(m, m, value) for m in ("avg", "varp", "min", "count")))
    assert Nest((level,)).frame(sensor).first()[:] == (dt.datetime(2017, 3, 27, 15, 59), 1, 74, 18, 69, 6)
    assert json.loads(Nest((level,)).json(sensor).first().json)["avg"] == 74


def test_two_levels_and_null_keys(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 3)], "k string, j string, v int")
    k, j = Group("k", resolve.field("k")), Group("j", resolve.field("j"))
    total = (Aggregate("v", "sum", resolve.field("v")),)
    got = Nest((Level((k,), total), Level((k, j), total))).frame(df).collect()
    assert sorted((str(r.k), str(r.j), r.level, r.v) for r in got) == sorted([("a", "None", 1, 3), ("None", "None", 1, 3), ("a", "x", 0, 1), ("a", "None", 0, 2), ("None", "x", 0, 3)])


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_equals_batch(spark, tmp_path, batches):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(batches).write.parquet(f"{tmp_path}/in")
    nest = bucket_nest()
    stream = events_stream(spark, f"{tmp_path}/in", events.schema, files_per_trigger=1)
    got = run_to_table(nest, stream, f"{tmp_path}/out", f"{tmp_path}/c").select("bucket", "event_type", "n", "least")
    want = nest.frame(events).select("bucket", "event_type", "n", "least")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stream_update_mode(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events_stream(spark, f"{tmp_path}/in", events.schema, ("ts", "10 minutes"), 1)
    level = Level((Group("event_type", resolve.field("event_type")),), (Aggregate("n", "count"),))
    got = run_to_table(Nest((level,)), stream, f"{tmp_path}/out", f"{tmp_path}/c", "update")
    last = {r.event_type: r.n for r in got.orderBy("batch").collect()}
    assert last == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}


def test_configuration():
    assert config.check(CONFIG) == []
    bad = json.loads(CONFIG)
    bad["nestLevels"]["aggregate"][0]["methodName"] = "vh_acm_median"
    assert "median" in config.check(json.dumps(bad))[0]
    for text in ("{", "{}", '{"nestLevels": {"groupBy": [{"columnName": "a"}]}}', '{"nestLevels": [3]}'):
        assert len(config.check(text)) == 1


def test_resolution(spark):
    df = spark.createDataFrame([(1, 2)], "first_name int, last_name int")
    assert df.select(resolve.field("last_name")(df)).first()[0] == 2
    with pytest.raises(KeyError):
        resolve.field("Last_name")(df)


def test_schema(spark):
    s = Schema()
    a, b = s.add(TableSpec("a")), s.add(TableSpec("b"))
    s.relate("a", "b", "1:N", ("k", "ak"))
    assert s.between("b", "a").cardinality == "N:1" and s.between("b", "a").pairs == (("ak", "k"),)
    a.add_version("1", spark.createDataFrame([], "k int").schema)
    a.add_version("2", spark.createDataFrame([], "k int, z string").schema)
    assert a.has("z") and not a.has("z", "1") and not a.has("Z") and b.name == "b"
    assert a.lifted(spark.createDataFrame([(5,)], "k int")).first()[:] == (5, None)


def test_builder_is_immutable(spark):
    df = spark.range(20)
    base = q.Select(df).order("id")
    assert [r.id for r in base.limit(3).offset(2).frame_().collect()] == [2, 3, 4]
    assert base.limit(0).frame_().count() == 20 and base.offset(5).frame_().count() == 20
    assert [r.id for r in base.where("id", "<", 2).where("id", "=", 7, "or").where("id", ">", 7).frame_().collect()] == [0, 1]


def test_range_join_matches_theta(spark):
    rng = random.Random(6)
    a = spark.createDataFrame([(i, float(x := rng.randint(0, 90)), x + float(rng.randint(0, 40))) for i in range(40)], "i int, lo double, hi double")
    b = spark.createDataFrame([(float(rng.randint(0, 130)),) for _ in range(60)], "x double")
    got = q.range_join(a, b, 7.0, "lo", "hi", "x").groupBy("i").count()
    want = a.join(b, (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).groupBy("i").count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    assert sorted(q.deleted(t, F.col("v") == "a").collect()) == [(2, None), (3, "c")]
    assert sorted(q.updated(t, spark.createDataFrame([(2, "b"), (9, "z")], t.schema), ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(q.synced(t, spark.createDataFrame([(3, "d"), (4, "e")], t.schema), ["k"]).where("k > 2").collect()) == [(3, "d"), (4, "e")]
    assert q.changed_fields(t, spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], t.schema), ["k"]).collect() == [(2, ["v"])]
    assert [r.k for r in q.trimmed(t, [F.col("k")], 2).collect()] == [3]


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    df = spark.createDataFrame(
        [(1, 48518922, 2147483648, 15.12, "é", True, dt.date(2016, 2, 29), dt.datetime(2017, 3, 21, 12, 37, 7), [1, None]), (None, -10, -2147483649, -249.99, "", False, None, None, None)],
        "s short, i int, l bigint, d double, t string, b boolean, day date, at timestamp_ntz, a array<int>",
    )
    store.append("t", df)
    assert sorted(map(str, store.read("t").collect())) == sorted(map(str, df.collect()))
    store.replace("t", store.read("t").where("i > 0"))
    store.append("t", df.where("i > 0"))
    assert store.read("t").count() == 2 and store.columns("t")[0] == ("s", "smallint")
    assert printed(df.select("day", "i"), {"day": "EEEE, MMMM d, yyyy"}).orderBy("line").collect()[1].line == "Monday, February 29, 2016\t48518922"
    assert sql(spark, "SELECT i FROM {t} WHERE i > :least", {"least": 0}, t=df).collect() == [(48518922,)]


def test_tableset_without_children(spark):
    parent = spark.createDataFrame([(1,), (2,)], "p int")
    child = spark.createDataFrame([(10, 1), (11, 1)], "c int, fk int")
    got = {r.p: [x.c for x in r.kids] for r in fetch(Node("roots", parent, (), (Node("kids", child, (("p", "fk"),)),))).collect()}
    assert got == {1: [10, 11], 2: []}


def test_neighbours_in_blocks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.random() for _ in range(4)], rng.randint(0, 2)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    test, train = df.where("id % 3 = 0"), df.where("id % 3 <> 0")
    for kind in ml.DISTANCES:
        one, many = (ml.neighbours(test, train, 3, kind, b).select("id", "rank", "train_id") for b in (2048, 20))
        assert one.exceptAll(many).isEmpty() and one.count() == 150
    assert ml.knn_mean(test, train).count() == 50


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["bucket", "event_type", "n", "mean", "spread", "least"]
    assert set(e.oracle_sql()) <= set(e.queries())
