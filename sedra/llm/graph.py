"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its larger (or smaller) neighbours to the least of its neighbours and itself.

    The least neighbours are summed partially and written before they are joined
    back: a join on the aggregate itself would take over its partitioning, and
    adaptive execution could not split a hub's links.
    """
    to = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(to.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
    linked = to.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return written(out.where("a <> b").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """Rows (a, b) of links between longs -> (node, root), root the least node reachable.

    Nodes without links are not in the result. Each pass is written to the shared
    folder; the passes end when the set of links stays the same, which count and
    two sums of hashes tell. Nothing but those numbers reaches the driver.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "links")
    was = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("long"))).first()
        if mark == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = mark
        now = _starred(_starred(now, True), False)
