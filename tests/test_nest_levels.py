"""Levels of a nest with aggregates of their own."""

import json

import pytest
from pyspark.sql import functions as F

from sedra.functions.resolve import field
from sedra.plans import config
from sedra.plans.nest import Aggregate, Group, Level, Nest


def levels(a, b):
    return Nest((Level((Group("a", field("a")),), a), Level((Group("a", field("a")), Group("b", field("b"))), b)))


def test_levels_with_different_aggregates(spark):
    df = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), (None, "p", 4)], "a string, b string, v int")
    nest = levels((Aggregate("n", "count"), Aggregate("sum", "sum", field("v"))), (Aggregate("n", "count"), Aggregate("most", "max", field("v"))))
    got = {tuple(r) for r in nest.frame(df).select("a", "b", "level", "n", "sum", "most").collect()}
    assert got == {("x", None, 1, 2, 3, None), (None, None, 1, 1, 4, None), ("x", "p", 0, 1, None, 1), ("x", "q", 0, 1, None, 2), (None, "p", 0, 1, None, 4)}


def test_one_name_for_different_aggregates(spark):
    df = spark.createDataFrame([("x", "p", 1)], "a string, b string, v int")
    for other in (Aggregate("m", "max", field("v")), Aggregate("m", "min", lambda d: F.col("v") + 1)):
        with pytest.raises(ValueError, match="two levels use m"):
            levels((Aggregate("m", "min", field("v")),), (other,)).frame(df)


def test_configured_levels(spark):
    df = spark.createDataFrame([("x", "p", 1), ("x", "q", 2)], "a string, b string, v int")
    path = lambda c: {"methodName": "field", "fieldName": c}
    group = lambda *c: [{"columnName": x, "searchPath": path(x)} for x in c]
    value = lambda n, m: [{"columnName": n, "methodName": m, "searchPath": path("v")}]
    text = json.dumps({"nestLevels": [{"groupBy": group("a"), "aggregate": value("total", "vh_acm_sum")}, {"groupBy": group("a", "b"), "aggregate": value("most", "vh_acm_max")}]})
    got = {tuple(r) for r in config.run(text, df).select("a", "b", "total", "most").collect()}
    assert got == {("x", None, 3, None), ("x", "p", None, 1), ("x", "q", None, 2)}
