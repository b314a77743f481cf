"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Targets: every source wants budget * weight / all weights, is clamped at
max_epochs times its size, and what the clamped ones leave is shared among the
others in proportion to weight, until none is above its clamp. Sampling: a source
at 1.4 epochs gives every document once, and once more those whose seeded hash is
below a cutoff chosen so that the taken words meet the target to within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import packed, words_of, written

#: Hash order is 63 bits wide; its top bits deal a source's documents into so many buckets.
BUCKET_BITS = 12


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def weights_in_turn(sources: DataFrame, cycle: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """Adds `weight` to one row per source, by code point with null last, the cycle repeating."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), turn % len(cycle) + 1))


def water_level(sources: DataFrame, share: float, max_epochs: float) -> float:
    """The level at which min(max_epochs * source_size, level * weight) sums to share * all sizes.

    Each pass clamps the sources above the level and deals what is left to the
    others; the level only rises, so the passes end when no more are clamped.
    """
    cap = F.col("source_size") * max_epochs
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * level > cap
        row = sources.agg(
            (F.sum("source_size") * share).alias("budget"),
            F.sum(F.when(over, cap)).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if not row.budget or row.n == clamped:
            return level
        if not row.free:
            return float("inf")
        level, clamped = (row.budget - (row.fixed or 0.0)) / row.free, row.n


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", *, cycle: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, carry: bool = True) -> DataFrame:
    """One row per document: struct `row` (null fields if carry is False), doc_id, size, source_size, target, copies, taken.

    size is the number of words, null texts have 0. `taken` is size * copies.
    The hash is of seed, id and text, so reruns agree whatever the partitioning;
    rows equal in both are taken together. Null sources are one source, the last.
    An empty table gives an empty table. The source table has one row per source
    and is the only thing sorted in one task; every sum over documents is partial first.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 1)
    table = packed(docs, doc_id=F.col(doc_id), source=F.col(source).cast("string"), size=F.size(words_of(F.col(text))).cast("long"), u=u)
    if not carry:
        table = table.drop("row")
    table = written(table.withColumn("key", _key(F.col("source"))).withColumn("bucket", F.shiftright("u", 63 - BUCKET_BITS)), "sizes")

    sources = table.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    sources = written(weights_in_turn(sources, cycle), "sources")
    level = water_level(sources, share, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    target = cap if level == float("inf") else F.least(cap, F.col("weight") * F.lit(level))
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(1)).cast("int")
    sources = sources.withColumn("target", target).withColumn("whole", whole).withColumn("quota", F.col("target") - F.col("whole") * size)

    # The bucket in which each source's fractional repetition ends, then the cutoff within it.
    by_bucket = Window.partitionBy("key").orderBy("bucket")
    deals = table.groupBy("key", "bucket").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(by_bucket))
    ends = deals.join(sources.select("key", "quota"), "key").where("upto > quota").groupBy("key", "quota").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("end"))
    ends = written(ends.select("key", "quota", "end.bucket", "end.before"), "ends")
    last = table.select("key", "bucket", "u", "size").join(ends, ["key", "bucket"]).groupBy("key", "u", "quota", "before").agg(F.sum("size").alias("words"))
    reached = F.col("before") + F.sum("words").over(Window.partitionBy("key").orderBy("u")) - F.col("words") / 2
    cutoffs = last.withColumn("reached", reached).where("reached <= quota").groupBy("key").agg(F.max("u").alias("cutoff"))
    start = F.shiftleft(F.col("bucket"), 63 - BUCKET_BITS) - 1
    plan = sources.join(ends.select("key", start.alias("start")), "key", "left").join(cutoffs, "key", "left")
    plan = plan.select("key", "source_size", "target", "whole", F.coalesce("cutoff", "start", F.lit(2**63 - 1).cast("long")).alias("cutoff"))
    plan = written(plan.withColumn("cutoff", F.when(F.col("source_size") * F.col("whole") < F.col("target"), F.col("cutoff")).otherwise(F.lit(-1).cast("long"))), "mix")

    copies = F.col("whole") + F.when(F.col("u") <= F.col("cutoff"), 1).otherwise(0)
    out = table.join(plan, "key").withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*(["row"] if carry else []), "doc_id", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    return mix(docs, **options).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
