"""Exact top-k by inner product, term at a time.

Candidates and queries are dealt to blocks; each pair of a query block and a
candidate block is one group. In it the candidates are posting lists by dimension,
and every query row with weight there adds the weighted postings to its row of a
dense score array. The best k of a block are partitioned off, and merged by query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import groups_for, written


def whole_vectors(rows: DataFrame, vector: str, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as long; null where the vector is null or has a null or non-finite component."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    large = F.raise_error(F.lit("a component is beyond a long")).cast("bigint")
    return F.when(~bad, F.transform(x, lambda v: F.when(F.abs(v * scale) >= 2.0**63, large).otherwise(F.floor(v * scale))))


def _kind(most: int) -> type:
    """The narrowest type that holds integers up to `most` in size; Python's own beyond a long."""
    return next((t for t in (np.int32, np.int64) if most <= np.iinfo(t).max), object)


def block_scores(queries: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """Dense scores [query, candidate]; vectors may differ in length, missing components are zero.

    The arrays are as wide as the largest components ask for, so that no score wraps around.
    """
    width = max(map(len, candidates), default=0)
    most = [max((max(-int(v.min()), int(v.max())) for v in side if len(v)), default=0) for side in (queries, candidates)]
    kind = _kind(max(most[0] * most[1] * width, *most))
    scores = np.zeros((len(queries), len(candidates)), dtype=kind)
    held = np.zeros((width, len(candidates)), dtype=kind)
    for i, c in enumerate(candidates):
        held[: len(c), i] = c
    asked = np.zeros((len(queries), width), dtype=kind)
    for i, q in enumerate(queries):
        asked[i, : min(width, len(q))] = q[:width]
    for term in range(width):
        ids = np.flatnonzero(held[term])  # the posting list of this term
        rows = np.flatnonzero(asked[:, term])
        if len(ids) == len(candidates):
            for r in rows:
                scores[r] += asked[r, term] * held[term]
        elif len(ids):
            for r in rows:
                scores[r, ids] += asked[r, term] * held[term, ids]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id: all above the k-th score, then the least ids at it."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_k(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, block: int = 4096, query_block: int = 32768) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each id divisible by `every`, against all rows of another id.

    Rows with null id or unusable vectors take no part; an id that is repeated among
    the queries asks once, with its least vector; repeated candidates are candidates
    each. A component or a returned score beyond a long raises. Candidates are dealt
    to blocks of about `block` rows by hash and travel once for each query_block
    queries; a group's score array is 256 * block numbers, for a slice of queries.
    """
    usable = written(rows.select(F.col(vec_id).cast("long").alias("id"), whole_vectors(rows, vector).alias("v")).where("id is not null and v is not null"), "vectors")
    asked = usable.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    n_blocks, q_blocks = groups_for(usable.count(), block), groups_for(asked.count(), min(query_block, 8 * block))
    dealt = lambda side, n: F.pmod(F.xxhash64("id", F.lit(side)), F.lit(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", dealt("q", q_blocks)).withColumn("c", span(n_blocks)).withColumn("asks", F.lit(True))
    right = usable.withColumn("c", dealt("c", n_blocks)).withColumn("q", span(q_blocks)).withColumn("asks", F.lit(False))

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        queries, candidates = frame[asks], frame[~asks]
        ids, vectors = candidates["id"].to_numpy(), list(candidates["v"])
        found = []
        for at in range(0, len(queries), 256):
            some = queries.iloc[at : at + 256]
            for qid, row in zip(some["id"], block_scores(list(some["v"]), vectors)):
                other = np.flatnonzero(ids != qid)
                top = other[best(row[other], ids[other], k)]
                if row.dtype == object and len(top) and max(map(abs, row[top])) >= 1 << 63:
                    raise OverflowError(f"a score of query {qid} is beyond a long")
                found.append(pd.DataFrame({"query_id": qid, "vec_id": ids[top], "score": row[top].astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    parts = left.unionByName(right).groupBy("q", "c").applyInPandas(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
