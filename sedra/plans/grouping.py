"""Queries of nests, configuration and streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import transforms as t
from ..functions.aggregates import register
from ..functions.resolve import field
from ..sources.store import scratch_dir
from ..streaming.nests import events_stream, run_to_table
from . import config
from .nest import Aggregate, Group, Level, Nest
from .registry import query

UPPER_6H = "make_timestamp((epoch_us(ts) // 21600000000 + 1) * 21600000000)"
BUCKET_SQL = f"""SELECT {UPPER_6H} AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value) + 3.7e-7, 4) AS spread, min(value) AS least
FROM events GROUP BY ALL"""


def bucket_nest() -> Nest:
    groups = (Group("bucket", lambda df: t.time_bucket(field("ts")(df), 6, "hours", lower=False)), Group("event_type", field("event_type")))
    value = field("value")
    return Nest((Level(groups, (Aggregate("n", "count"), Aggregate("mean", "avg", value), Aggregate("spread", "varp", value), Aggregate("least", "min", value))),))


def _rounded(df):
    """Rounds for comparison; variances of short decimals lie on ties, which the small addition avoids."""
    return df.withColumns({"mean": F.round("mean", 6), "spread": F.round(F.col("spread") + 3.7e-7, 4)})


@query(BUCKET_SQL)
def nest_bucket_type(table):
    """Upper six-hour bucket and type: count, mean, variance, least."""
    return _rounded(bucket_nest().frame(table("events")))


def _minute(table, lower):
    nest = Nest((Level((Group("bucket", lambda df: t.time_bucket(F.col("ts"), 1, "minutes", lower)),), (Aggregate("n", "count"),)),))
    return nest.frame(table("events"))


@query("SELECT make_timestamp((epoch_us(ts) // 60000000) * 60000000) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def nest_lower_minute(table):
    return _minute(table, True)


@query("SELECT make_timestamp((epoch_us(ts) // 60000000 + 1) * 60000000) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def nest_upper_minute(table):
    return _minute(table, False)


def _nine(key, column):
    value = field(column)
    aggregates = [Aggregate(m, m, value) for m in ("count", "sum", "min", "max", "avg", "varp", "vars", "devp", "devs")]
    return Nest((Level(tuple(Group(k, field(k)) for k in key), tuple(aggregates)),))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 2) AS sum, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS avg,
round(var_pop(l_quantity), 6) AS varp, round(coalesce(var_samp(l_quantity), 0), 6) AS vars, round(stddev_pop(l_quantity), 6) AS devp, round(coalesce(stddev_samp(l_quantity), 0), 6) AS devs FROM lineitem GROUP BY ALL""")
def nest_nine_float(table):
    """All nine accumulators over doubles."""
    out = _nine(("l_returnflag", "l_linestatus"), "l_quantity").frame(table("lineitem"))
    return out.withColumns({c: F.round(c, 2 if c == "sum" else 6) for c in ("sum", "avg", "varp", "vars", "devp", "devs")})


@query("""WITH s AS (SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS s, sum(p_size * p_size)::BIGINT AS q, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand),
v AS (SELECT *, CASE WHEN n > 0 THEN (n * q - s * s) // (n * n) ELSE 0 END AS varp, CASE WHEN n > 1 THEN (n * q - s * s) // (n * (n - 1)) ELSE 0 END AS vars FROM s)
SELECT p_brand, n AS count, s AS sum, lo AS min, hi AS max, (s // n)::BIGINT AS avg, varp::BIGINT AS varp, vars::BIGINT AS vars, floor(sqrt(varp))::BIGINT AS devp, floor(sqrt(vars))::BIGINT AS devs FROM v""")
def nest_nine_int(table):
    """All nine accumulators over integers, in integer form."""
    return _nine(("p_brand",), "p_size").frame(table("part"))


_HOUR = "epoch_us(date_trunc('hour', ts))"


@query(f"""WITH e AS (SELECT event_type, {_HOUR} AS hour, epoch_us(ts)::HUGEINT AS x FROM events),
b AS (SELECT *, x - min(x) OVER (PARTITION BY event_type, hour) AS d FROM e),
s AS (SELECT event_type, hour, count(*)::HUGEINT AS n, sum(x)::BIGINT AS s, min(x)::BIGINT AS lo, max(x)::BIGINT AS hi, sum(d)::HUGEINT AS t, sum(d * d)::HUGEINT AS q FROM b GROUP BY ALL),
v AS (SELECT *, ((n * q - t * t) // (n * n))::BIGINT AS varp, CASE WHEN n > 1 THEN ((n * q - t * t) // (n * (n - 1)))::BIGINT ELSE 0 END AS vars FROM s)
SELECT event_type, hour::BIGINT AS hour, n::BIGINT AS count, s AS sum, lo AS min, hi AS max, (s // n)::BIGINT AS avg, varp, vars, floor(sqrt(varp))::BIGINT AS devp, floor(sqrt(vars))::BIGINT AS devs FROM v""")
def nest_nine_long(table):
    """All nine accumulators over microseconds since 1970, whose squares are beyond 38 digits when summed and multiplied."""
    rows = table("events").withColumns({"x": F.unix_micros(F.col("ts").cast("timestamp")), "hour": F.unix_micros(F.date_trunc("hour", "ts").cast("timestamp"))})
    return _nine(("event_type", "hour"), "x").frame(rows)


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level,
CASE WHEN grouping_id(l_returnflag, l_linestatus) = 1 THEN count(*) END AS n, CASE WHEN grouping_id(l_returnflag, l_linestatus) = 0 THEN max(l_linenumber) END AS most, min(l_linenumber) AS least
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))""")
def nest_levels_own(table):
    """Two levels with an aggregate of their own each, and one that both name."""
    flag, status = Group("flag", field("l_returnflag")), Group("status", field("l_linestatus"))
    line = field("l_linenumber")
    least = Aggregate("least", "min", line)
    out = Nest((Level((flag,), (Aggregate("n", "count"), least)), Level((flag, status), (Aggregate("most", "max", line), least)))).frame(table("lineitem"))
    return out.withColumn("level", F.col("level").cast("long"))


register("width", lambda c: F.max(c) - F.min(c))


@query("SELECT p_brand, max(p_size) - min(p_size) AS w FROM part GROUP BY p_brand")
def nest_own_accumulator(table):
    """An accumulator that isn't built in."""
    return Nest((Level((Group("p_brand", field("p_brand")),), (Aggregate("w", "width", field("p_size")),)),)).frame(table("part"))


@query("""SELECT c_mktsegment AS segment, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY ALL""")
def nest_null_group(table):
    """A null key forms a group."""
    rows = table("orders").join(table("customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return Nest((Level((Group("segment", field("c_mktsegment")),), (Aggregate("n", "count"),)),)).frame(rows)


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, round(sum(l_quantity), 2) AS total
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))""")
def nest_levels(table):
    """Two levels over one scan."""
    flag, status = Group("flag", field("l_returnflag")), Group("status", field("l_linestatus"))
    aggregates = (Aggregate("n", "count"), Aggregate("total", "sum", field("l_quantity")))
    out = Nest((Level((flag,), aggregates), Level((flag, status), aggregates))).frame(table("lineitem"))
    return out.withColumns({"level": F.col("level").cast("long"), "total": F.round("total", 2)})


@query("SELECT event_type, round(avg(coalesce(CASE WHEN value > 10 THEN value END, 0)), 6) AS mean FROM events GROUP BY ALL")
def nest_agg_transformed(table):
    """An accumulator over a transformed column."""
    big = lambda df: t.default_value(F.when(F.col("value") > 10, F.col("value")), 0.0, True)
    out = Nest((Level((Group("event_type", field("event_type")),), (Aggregate("mean", "avg", big),)),)).frame(table("events"))
    return out.withColumn("mean", F.round("mean", 6))


@query("""SELECT '{"flag":"' || l_returnflag || '","status":"' || l_linestatus || '","n":' || count(*) || ',"least":' || min(l_linenumber) || '}' AS json FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def nest_json(table):
    """Groups as JSON objects, in descending key order."""
    level = Level((Group("flag", field("l_returnflag")), Group("status", field("l_linestatus"))), (Aggregate("n", "count"), Aggregate("least", "min", field("l_linenumber"))))
    return Nest((level,)).json(table("lineitem"))


@query("SELECT l_returnflag, count(*) AS count, max(l_quantity) AS max FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def group_fetch(table):
    """One group by its key; the filter reaches the scan."""
    nest = Nest((Level((Group("l_returnflag", field("l_returnflag")),), (Aggregate("count", "count"), Aggregate("max", "max", field("l_quantity")))),))
    return nest.one(table("lineitem"), l_returnflag="R")


CONFIG = json.dumps({
    "nestLevels": {
        "groupBy": [
            {"groupByType": "PrepCol", "columnName": "bucket", "searchPath": {"methodName": "field", "fieldName": "ts"}, "prepCol": {"methodName": "tsint", "interval": 6, "intervalType": "hours", "lower": False}},
            {"columnName": "event_type", "searchPath": {"methodName": "field", "fieldName": "event_type"}},
        ],
        "aggregate": [{"methodName": f"vh_acm_{m}", "columnName": n, "searchPath": {"methodName": "field", "fieldName": "value"}} for m, n in (("count", "n"), ("avg", "mean"), ("varp", "spread"), ("min", "least"))],
    }
})


@query(BUCKET_SQL)
def cfg_nest(table):
    """The flagship nest, from its JSON configuration."""
    return _rounded(config.run(CONFIG, table("events")))


_TYPE = {"columnName": "event_type", "searchPath": {"methodName": "field", "fieldName": "event_type"}}
_DEFAULT = {"groupByType": "PrepCol", "columnName": "all", "searchPath": {"methodName": "field", "fieldName": "user_id"}, "prepCol": {"methodName": "vh_pc_defaultv_create", "defaultValue": "every"}}
CONFIG_LEVELS = json.dumps({
    "nestLevels": [
        {"groupBy": [_DEFAULT], "aggregate": [{"methodName": "vh_acm_count", "columnName": "n", "searchPath": {"methodName": "field", "fieldName": "value"}}]},
        {"groupBy": [_DEFAULT, _TYPE], "aggregate": [{"methodName": "vh_acm_max", "columnName": "most", "searchPath": {"methodName": "field", "fieldName": "value"}}]},
    ]
})


@query("""SELECT 'every' AS all_, event_type, grouping_id(event_type)::BIGINT AS level, CASE WHEN grouping_id(event_type) = 1 THEN count(*) END AS n,
CASE WHEN grouping_id(event_type) = 0 THEN max(value) END AS most FROM events GROUP BY GROUPING SETS ((), (event_type))""")
def cfg_levels(table):
    """Two configured levels, each with an aggregate of its own, under a default value as key."""
    out = config.run(CONFIG_LEVELS, table("events"))
    return out.withColumn("level", F.col("level").cast("long")).withColumnRenamed("all", "all_")


@query(BUCKET_SQL)
def stream_nest(table):
    """The flagship nest fed by a stream until nothing is left, in complete mode."""
    events = table("events")
    spark, files = events.sparkSession, events.inputFiles()
    run = f"{scratch_dir(spark)}/sedra-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    folder, _, name = files[0].rpartition("/")
    stream = events_stream(spark, folder, events.schema, glob=name if len(files) == 1 else "*.parquet")
    return _rounded(run_to_table(bucket_nest(), stream, f"{run}/table", f"{run}/checkpoint"))
