"""Small classifiers: k nearest neighbours, Gaussian naive Bayes, min-max scaling."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISTANCES = ("euclid", "manhattan", "dot")


def distance(kind: str, a: Column, b: Column) -> Column:
    """Distance of two array columns in double."""
    term = {"euclid": lambda x, y: (x - y) * (x - y), "manhattan": lambda x, y: F.abs(x - y), "dot": lambda x, y: x * y}[kind]
    total = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total) if kind == "euclid" else total


def _block_distances(kind: str, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if kind == "dot":
        return q @ c.T
    apart = q[:, None, :] - c[None, :, :]
    return np.sqrt((apart * apart).sum(axis=2)) if kind == "euclid" else np.abs(apart).sum(axis=2)


def _first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each set of equal vectors, in order."""
    rows = np.ascontiguousarray(vectors)
    if not rows.shape[1]:
        return np.arange(min(k, len(rows)))
    of = np.unique(rows.view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_inverse=True)[1]
    return np.sort(np.lexsort((np.arange(len(of)), of))[_ranks(np.sort(of)) < k])


def _ranks(groups: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal values."""
    first = np.append(True, groups[1:] != groups[:-1])[: len(groups)]
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _within(scores: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the scores up to the bound of their row; quick where they are few."""
    bits = np.packbits(scores <= bound[:, None])
    some = np.flatnonzero(bits)
    at, bit = np.nonzero(np.unpackbits(bits[some, None], axis=1))
    return np.divmod(some[at] * 8 + bit, scores.shape[1])


def _plain(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs (i, j) by the plain formula, rounded."""
    step = max(1, (1 << 20) // max(1, q.shape[1]))
    d = [np.sqrt(((q[i[x : x + step]] - c[j[x : x + step]]) ** 2).sum(axis=1)) for x in range(0, len(i), step)]
    return np.concatenate(d or [np.empty(0)]).round(9)


def _near(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `_nearest` returns for Euclidean distances whose squares don't overflow.

    Squared distances of a slice of c are one matrix product, c having two more columns, of
    ones and of its squared lengths, in single precision first; a row of q of which that leaves
    too many pairs near, as among near copies, goes on in double. `slack` is more than the
    rounding of the product and of the plain formula, so that a pair beyond the bound can't be
    among the nearest, nor tie with them in nine digits. The pairs within it are judged by the
    plain formula, which costs as much as a hundred by a product.
    """
    found, slice_ = [], max(2048, k)
    step = max(1, (1 << 20) // slice_)
    double = np.column_stack([c, np.ones(len(c)), (c * c).sum(axis=1)])
    wide = {np.float64: double}
    for at in range(0, len(q), step):
        few = q[at : at + step]
        squares = (few * few).sum(axis=1)
        asked, sums = np.column_stack([-2 * few, squares, np.ones(len(few))]), squares + double[:, -1].max()
        by, none = np.arange(len(few)), np.empty(0, dtype=np.int64)
        rows = {np.float32: by, np.float64: none} if sums.max() < 1e30 else {np.float32: none, np.float64: by}
        asks = {kind: asked[by].astype(kind) for kind, by in rows.items()}
        i = j = none
        d = most = np.empty(0)
        for x in range(0, len(c), slice_):
            near = [none], [none]
            for kind in (np.float32, np.float64):
                by = rows[kind]
                if not len(by):
                    continue
                if kind not in wide:
                    wide[kind] = double.astype(kind)
                slack = 8 * (q.shape[1] + 8) * np.finfo(kind).eps * sums[by]
                scores = asks[kind] @ wide[kind][x : x + slice_].T
                if x:
                    edge = most[by]
                elif scores.shape[1] < k:
                    edge = np.full(len(by), np.inf)
                else:
                    edge = np.sqrt(np.maximum(np.partition(scores, k - 1, axis=1)[:, k - 1], 0) + slack)
                bound = np.nextafter(((edge + 2e-9) ** 2 * (1 + 1e-12) + slack).astype(kind), kind(np.inf))
                n, m = _within(scores, bound)
                if kind is np.float32:
                    many = np.bincount(n, minlength=len(by)) > 2 * k + scores.shape[1] // 128
                    if many.any():
                        rows = {np.float32: by[~many], np.float64: np.append(rows[np.float64], by[many])}
                        asks = {kind: asked[by].astype(kind) for kind, by in rows.items()}
                        n, m = n[~many[n]], m[~many[n]]
                near[0].append(by[n])
                near[1].append(m)
            n, m = (np.concatenate(y) for y in near)
            i, j, d = np.append(i, n), np.append(j, m + x), np.append(d, _plain(few, c[x : x + slice_], n, m))
            order = np.lexsort((j, d, i))
            order = order[_ranks(i[order]) < k]
            i, j, d = i[order], j[order], d[order]
            most = d[k - 1 :: k]
        found.append((i + at, j, d))
    return tuple(np.concatenate(x) for x in zip(*found))


def _nearest(kind: str, q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in q and c and rounded distances of the k nearest of each row of q, ties to the first in c."""
    with np.errstate(over="ignore"):
        if kind == "euclid" and np.isfinite(64 * (q * q).sum(axis=1).max() + 64 * (c * c).sum(axis=1).max()):
            return _near(q, c, k)
    found = []
    for at in range(0, len(q), 16):
        d = _block_distances(kind, q[at : at + 16], c).round(9)
        j = np.argsort(d, axis=1, kind="stable")[:, :k]
        found.append((np.repeat(np.arange(at, at + len(d)), j.shape[1]), j.ravel(), np.take_along_axis(d, j, axis=1).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))


def _blocks(n_test: int, n_train: int, test_block: int, block: int, cores: int) -> tuple[int, int]:
    """How many blocks either side is dealt to: as few as the bounds allow, more where cores would idle over groups of many pairs."""
    q, c = max(1, -(-n_test // test_block)), max(1, -(-n_train // block))
    want = min(2 * cores, n_test * n_train >> 25)
    more = math.isqrt(max(0, want - 1) // (q * c)) + 1
    return q * more, c * more


def neighbours(test: DataFrame, train: DataFrame, k: int = 3, kind: str = "euclid", block: int = 32768, test_block: int = 32768) -> DataFrame:
    """(id, rank, train_id, label, dist): the k nearest rows of train for each row of test; both have id, v, label.

    Labels keep their type and value. Null vectors and those with a null or non-finite
    component take no part, and vectors are compared with those of their length
    only. Each block of train meets each block of test in one group and task; the best k of a
    group are kept for each test row, then merged. All pairs are judged, Euclidean ones
    by a matrix product first, and by the plain formula where it leaves them near. Ties
    in distance, rounded to nine digits, go to the smaller train id. Arrays of float
    travel as such; distances are of doubles.
    """
    whole = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    single = all(df.schema["v"].dataType.simpleString() == "array<float>" for df in (test, train))
    usable = lambda df: df.withColumn("v", F.col("v").cast("array<float>" if single else "array<double>")).where(F.col("v").isNotNull() & whole(F.col("v")))
    n_test, n_train = _blocks(test.count(), train.count(), test_block, block, test.sparkSession.sparkContext.defaultParallelism)
    test, train = usable(test), usable(train)
    label = train.schema["label"].dataType.simpleString()
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = test.select("id", "v", F.lit(None).cast(label).alias("label"), F.pmod(F.xxhash64("id"), F.lit(n_test)).alias("q"), span(n_train).alias("c"), F.lit(True).alias("asks"))
    right = train.select("id", "v", "label", span(n_test).alias("q"), F.pmod(F.xxhash64("id"), F.lit(n_train)).alias("c"), F.lit(False).alias("asks"))

    def best(group: pa.Table) -> pa.Table:
        asks, ids, labels, vectors = group["asks"].to_numpy(), group["id"], group["label"], group["v"].combine_chunks()
        lengths, order = vectors.value_lengths().to_numpy(), ids.to_numpy()
        taken = lambda at, width: vectors.take(pa.array(at)).flatten().to_numpy().reshape(len(at), width).astype(float)
        rows, near, dist = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
        for length in np.unique(lengths[asks]):
            q, c = (np.flatnonzero((asks == side) & (lengths == length)) for side in (True, False))
            if not len(c):
                continue
            c = c[np.argsort(order[c], kind="stable")]
            held = taken(c, length)
            kept = _first_copies(held, k)
            i, j, d = _nearest(kind, taken(q, length), held[kept], k)
            rows, near, dist = [*rows, q[i]], [*near, c[kept[j]]], [*dist, d]
        at, to = (pa.array(np.concatenate(x)) for x in (rows, near))
        return pa.table({"id": ids.take(at), "train_id": ids.take(to), "label": labels.take(to), "dist": np.concatenate(dist)})

    group = (F.col("q") * n_train + F.col("c")).cast("int").alias("group")
    dealt = left.unionByName(right).select(F.col("id").cast("long").alias("id"), "v", "label", "asks", group).repartitionById(n_test * n_train, "group")
    parts = dealt.groupBy("group").applyInArrow(best, f"id long, train_id long, label {label}, dist double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "train_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_predict(test: DataFrame, train: DataFrame, k: int = 3, kind: str = "euclid") -> DataFrame:
    """(id, predicted): the majority label of the k nearest; ties go to the greatest label."""
    votes = neighbours(test, train, k, kind).groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.max(F.struct("n", "label")).alias("top")).select("id", F.col("top.label").alias("predicted"))


def knn_mean(test: DataFrame, train: DataFrame, k: int = 3, kind: str = "euclid") -> DataFrame:
    """(id, predicted): the mean label of the k nearest."""
    return neighbours(test, train, k, kind).groupBy("id").agg(F.avg("label").alias("predicted"))


def density(x: Column, mean: Column, dev: Column) -> Column:
    """Gaussian density."""
    return F.exp(-((x - mean) * (x - mean)) / (2 * dev * dev)) / (F.lit(math.sqrt(2 * math.pi)) * dev)


def nb_predict(test: DataFrame, train: DataFrame, label: str, features: list[str]) -> DataFrame:
    """test with `predicted`: the class of highest log prior plus log densities; ties go to the smallest class.

    Class statistics are one grouping of train; they reach test as one array, one
    entry per class. Features without spread in a class are left out there.
    """
    stats = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{p}_{c}") for c in features for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    model = stats.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("class"), *[c for c in stats.columns if c != label]))).alias("model")).select("model").scalar()
    total = stats.agg(F.sum("n")).scalar()

    def score(k: Column) -> Column:
        out = F.log(k["n"] / F.col("_total"))
        for c in features:
            s, d = k[f"s_{c}"], F.col(c) - k[f"m_{c}"]
            out = out + F.when(s > 0, -(d * d) / (2 * s * s) - F.log(s) - math.log(math.sqrt(2 * math.pi))).otherwise(0.0)
        return out

    scored = test.withColumns({"_model": model, "_total": total})
    scored = scored.withColumn("_scores", F.transform("_model", lambda k: F.struct(score(k).alias("s"), k["class"].alias("c"))))
    top = F.array_max(F.transform("_scores", lambda x: x["s"]))
    scored = scored.withColumn("_top", top)
    return scored.withColumn("predicted", F.array_min(F.transform(F.filter("_scores", lambda x: x["s"] == F.col("_top")), lambda x: x["c"]))).drop("_model", "_total", "_scores", "_top")


def accuracy(df: DataFrame, actual: str, predicted: str = "predicted") -> DataFrame:
    """Hits over rows."""
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def min_max_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns scaled to [0, 1] by bounds learnt in one pass; null where a column has no spread."""
    bounds = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    value = lambda n: bounds.select(n).scalar()
    return df.withColumns({c: F.try_divide(F.col(c).cast("double") - value(f"lo_{c}"), (value(f"hi_{c}") - value(f"lo_{c}")).cast("double")) for c in columns})
