"""Connected components: a hub of many links, chains and small cases."""

from pyspark.sql import functions as F

from sedra.llm import graph


def test_hub_and_chain(spark):
    n = 20_000
    hub = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(n, n + 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(hub.unionByName(chain)).groupBy("root").count()
    assert {tuple(r) for r in got.collect()} == {(0, n - 1), (n, 300)}  # the root is no row


def test_small_graphs(spark):
    links = spark.createDataFrame([(5, 4), (4, 5), (4, 3), (9, 8), (-1, 9), (7, 7)], "a long, b long")
    assert {tuple(r) for r in graph.components(links).collect() if r.node != r.root} == {(5, 3), (4, 3), (9, -1), (8, -1)}
    assert graph.components(links.limit(0)).count() == 0
