"""Near copies by the SimHash trie join over five-word shingles, each link compared exactly.

Texts are sets of five-word shingles; equal sets are one node. Sets of similarity 0.8
differ in about ten of the 64 bits of their fingerprints, too many for blocks of bits
to find them. Tries are dealt by bands of least hashes instead: nodes that agree in
ROWS least hashes of one of BANDS bands form a trie, which a pair at exactly 0.8 misses
in all bands with a chance of 3e-6. Each trie is walked in pairs of nodes as in
`simhash`, from another bit for each band, and gives its links within max_bits; those
are kept of which the exact similarity is 0.8 or more, so each link is right.

A trie of at most WHOLE nodes gives all its links at once. A larger one, where that
would be every pair of a family of copies, first gives those that hold it together,
at most one for each node, and those to the PIVOTS nodes nearest to its centre, from
which copies mostly come. What these links, once compared, leave in unlike classes is
walked again, and every pair within max_bits whose classes differ is compared too, by
its least hashes and then by its texts: no pair of a trie is left out unless its texts
are in one class already. A trie that is too large for one task is dealt as all pairs of
its chunks, so that this holds for it too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructType

from . import simhash
from .graph import components
from .shared import groups_for, packed, written

WORDS, SEED = 5, 42
BANDS, ROWS = 32, 5
#: Bits in which two fingerprints may differ; of pairs at 0.8, one in a thousand differs in more.
MAX_BITS = 18
#: Nodes of a trie that gives all its links at once, and central nodes of a larger one that all others are first compared with.
WHOLE, PIVOTS = 32, 4
#: Nodes of a trie that is not dealt as pairs of chunks.
TRIE_ROWS = 1 << 16
#: Least hashes that tell two nodes apart before their texts are compared, and the similarity that they must show: of whole sets,
#: short of 0.8 by what equal 32-bit hashes can change; of cut ones of unknown size by more than five standard deviations.
LEAST, NEARLY, ROUGHLY = 1024, 0.79, 0.73
_RANDOM = np.random.default_rng(SEED)
_FLIPS = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_FACTORS = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of five words each; fewer words are one shingle, none give none.

    Words are those of the op4 fingerprint: A-Z lower-cased, split at the six blanks.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    each = np.array([digest(w, SEED) for w in words], dtype=np.uint64)
    n = len(words) - WORDS + 1
    out = each[:n]
    for k in range(1, WORDS):
        out = (out ^ (out >> np.uint64(32))) * _MIX[0] + each[k : n + k]
    out = (out ^ (out >> np.uint64(30))) * _MIX[1]
    return np.unique(out ^ (out >> np.uint64(31)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sets of shingles is 0.8 or more, in whole numbers."""
    small, large = sorted((a, b), key=len)
    if 5 * len(small) < 4 * len(large):
        return False
    both = len(np.intersect1d(small, large, assume_unique=True))
    return 5 * both >= 4 * (len(small) + len(large) - both)


def _bands(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, ((short[at : at + 1024] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ (keys >> np.uint64(29)) ^ row.astype(np.uint64)) * _MIX[0]
        keys = (keys ^ (keys >> np.uint64(32))) * _MIX[1]
    return (keys ^ (keys >> np.uint64(31))).view(np.int64)


@F.pandas_udf(StructType().add("node", LongType()).add("n", LongType()).add("fp", LongType()).add("bands", ArrayType(LongType())))
def _sketches(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        found = shingles(text)
        node = np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64)
        out.append((node, len(found), simhash.majority([found]), _bands(found)))
    return pd.DataFrame(out, columns=["node", "n", "fp", "bands"])


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    last: dict[str, np.ndarray] = {}

    def of(text: str) -> np.ndarray:
        if text not in last:
            if len(last) > 8:
                last.pop(next(iter(last)))
            last[text] = shingles(text)
        return last[text]

    return pd.Series([alike(of(x), of(y)) for x, y in zip(a, b)], dtype="bool")


def _dealt(prints: DataFrame, trie_rows: int) -> DataFrame:
    """(node, n, band, fp, trie, held): the nodes by bands; a trie of over trie_rows nodes is dealt as pairs of its chunks.

    Its nodes fall into chunks of half of trie_rows by hash, and each two chunks are a
    trie, so that every two nodes still meet, however many agree in a band.
    """
    rows = prints.select("node", "n", "fp", F.posexplode("bands").alias("band", "trie"))
    held = written(rows.groupBy("trie").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
    # shuffled at every size: only the least inputs could broadcast the tries
    rows = rows.join(held.hint("merge"), "trie")
    chunks = F.ceil(F.col("held") / F.lit(max(1, trie_rows // 2)))
    mine = F.pmod(F.xxhash64("node"), chunks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda c: c != mine)
    pairs = F.transform(others, lambda c: F.xxhash64("trie", F.least(c, mine), F.greatest(c, mine)))
    return rows.withColumn("trie", F.explode(F.when(F.col("held") > trie_rows, pairs).otherwise(F.array("trie"))))


def tries(prints: DataFrame, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """Nodes (node, n, fp, bands) -> (node, n, trie, key, held): the fingerprint turned so that each band starts at bits of its own, and how many agree in the band."""
    turned = F.expr("(fp << 2 * band) | shiftrightunsigned(fp, 64 - 2 * band)")
    key = F.when(F.col("band") == 0, F.col("fp")).otherwise(turned)
    return _dealt(prints, trie_rows).select("node", "n", "trie", key.alias("key"), "held")


def _to_centres(frame: pd.DataFrame, max_bits: int, whole: int, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each trie of over `whole` nodes, links within max_bits to the `pivots` nodes nearest to the majority of its bits."""
    out = []
    sizes = frame.groupby("trie")["trie"].transform("size")
    for _, trie in frame[sizes > whole].sort_values("node").groupby("trie"):
        node, keys = trie["node"].to_numpy(), trie["key"].to_numpy().view(np.uint64)
        centre = np.int64(simhash.majority(np.array_split(keys, len(keys) // 65536 + 1))).view(np.uint64)
        for pivot in np.argsort(np.bitwise_count(keys ^ centre), kind="stable")[:pivots]:
            near = np.flatnonzero(np.bitwise_count(keys ^ keys[pivot]) <= max_bits)
            near = near[near != pivot]
            out.append((node[near], np.full(len(near), node[pivot])))
    return out


def _in_parts(rows: DataFrame, group_rows: int) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("trie"), F.lit(groups_for(rows.count(), group_rows))))


def _in_order(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def first_links(rows: DataFrame, max_bits: int, whole: int, pivots: int, group_rows: int = 8192) -> DataFrame:
    """Rows (node, trie, key) -> distinct links (a, b): all of small tries, those that hold larger ones together and those to their centres."""
    rows = _in_parts(rows.select("node", "trie", "key", F.lit(0).alias("lead")), group_rows)

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        found = [simhash.walked(frame, max_bits, whole), *_to_centres(frame, max_bits, whole, pivots)]
        return pd.DataFrame({c: np.concatenate([p[k] for p in found]) for k, c in enumerate("ab")})

    return _in_order(rows.groupBy("part").applyInPandas(link, "a long, b long"))


class _Samples:
    """The least hashes of several nodes, and which pairs of nodes they let be alike."""

    def __init__(self, least: list[bytes], held: np.ndarray | None = None):
        """held: of how many shingles each sample is; where given, a cut pair goes only if no rest of the two sets could make it alike."""
        self.held = held
        parts = [np.frombuffer(x, dtype=np.uint32) for x in least]
        self.size = np.array([len(x) for x in parts], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.ids = np.unique(np.concatenate(parts), return_inverse=True)[1]
        self.parts, self.mine = parts, np.zeros(len(self.ids), dtype=bool)

    def _whole(self, one: int, others: np.ndarray) -> np.ndarray:
        own = self.ids[self.start[one] :][: self.size[one]]
        sizes = self.size[others]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[others] - ends + sizes, sizes) + np.arange(ends[-1])
        self.mine[own] = True
        both = np.add.reduceat(self.mine[self.ids[at]], ends - sizes, dtype=np.int64)
        self.mine[own] = False
        return both >= NEARLY * (self.size[one] + sizes - both)

    def _cut(self, one: int, other: int) -> bool:
        a, b = self.parts[one], self.parts[other]
        top = min(x[-1] for x in (a, b) if len(x) == LEAST)
        a, b = a[a <= top], b[b <= top]
        both = len(np.intersect1d(a, b, assume_unique=True))
        if self.held is None:
            return both >= ROUGHLY * (len(a) + len(b) - both)
        n, m = int(self.held[one]), int(self.held[other])
        most = both + min(n - len(a), m - len(b))
        return most >= NEARLY * (n + m - most)

    def likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs may be alike: by all hashes, or, beyond LEAST of them, by those up to the lower of the last ones and all that may lie above."""
        out = np.zeros(len(i), dtype=bool)
        cut = (self.size[i] == LEAST) | (self.size[j] == LEAST)
        for k in np.flatnonzero(cut):
            out[k] = self._cut(i[k], j[k])
        rest = np.flatnonzero(~cut & (self.size[i] > 0) & (self.size[j] > 0))
        rest = rest[np.argsort(i[rest], kind="stable")]
        for few in np.split(rest, np.flatnonzero(np.diff(i[rest])) + 1):
            for some in np.split(few, range(4096, len(few), 4096)):
                if len(some):
                    out[some] = self._whole(i[some[0]], j[some])
        return out


@F.pandas_udf(BinaryType())
def _least(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique((shingles(t) >> np.uint64(32)).astype(np.uint32))[:LEAST].tobytes() for t in texts])


def links_across(rows: DataFrame, roots: DataFrame, table: DataFrame, prints: DataFrame, text: str, max_bits: int, whole: int, group_rows: int = 8192) -> DataFrame:
    """Rows (node, n, trie, key, held) of tries of over `whole` nodes and (node, root) -> links (a, b) within max_bits of unlike roots.

    Of those, the pairs go that the least LEAST hashes of their shingles tell apart.
    Texts of fewer shingles are told apart by all of them, so that a family of texts
    that nearly reach the similarity is not joined pair by pair with its texts; longer
    ones go where even a rest that is equal as far as it can be would not do.
    """
    large = rows.where(F.col("held") > whole).select("node", "n", "trie", "key")
    large = large.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    large = written(large, "large")
    split = large.groupBy("trie").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("trie")
    large = written(large.join(split, "trie", "left_semi"), "split")
    nodes = written(large.select("node").distinct().join(prints.select("node", F.col("first.uid").alias("uid")), "node"), "nodes")
    least = table.select("uid", F.col("row")[text].alias("text")).join(nodes, "uid").select("node", _least("text").alias("least"))
    large = _in_parts(large, group_rows).join(written(least, "least").hint("merge"), "node")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(frames, ignore_index=True)
        frame = frame.iloc[np.lexsort((frame["key"].to_numpy().view(np.uint64), frame["trie"].to_numpy()))]
        node, n = frame["node"].to_numpy(), frame["n"].to_numpy()
        samples = _Samples(frame["least"].tolist(), n)
        for i, j in simhash.across(frame, max_bits):
            fits = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            fits = samples.likely(i, j)
            yield pd.DataFrame({"a": node[i[fits]], "b": node[j[fits]]})

    return _in_order(large.groupBy("part").applyInPandas(link, "a long, b long"))


def compared(pairs: DataFrame, table: DataFrame, prints: DataFrame, text: str) -> DataFrame:
    """Links (a, b) -> those of which the texts are alike."""
    firsts = prints.select("node", "n", F.col("first.uid").alias("uid"))
    for side in "ab":
        pairs = pairs.join(firsts.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("uid").alias(f"uid_{side}")), side)
    pairs = written(pairs.where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"), "pairs")
    for side in "ab":
        pairs = pairs.join(table.select(F.col("uid").alias(f"uid_{side}"), F.col("row")[text].alias(f"text_{side}")), f"uid_{side}")
    return written(pairs.select("a", "b", _alike("text_a", "text_b").alias("near")).where("near").select("a", "b"), "near")


def in_tries(rows: DataFrame, table: DataFrame, prints: DataFrame, text: str) -> DataFrame:
    """Written table (uid, row) of one row for each node of a trie, its struct the text alone.

    Texts are looked up from here whenever nodes are compared, so that the whole table
    is shuffled for them once, at every size and however many links are found when.
    """
    nodes = rows.select("node").distinct().join(prints.select("node", F.col("first.uid").alias("uid")), "node")
    wanted = written(nodes.select("uid"), "wanted").hint("merge")
    return written(table.select("uid", F.struct(F.col("row")[text].alias(text)).alias("row")).join(wanted, "uid", "left_semi"), "texts")


def classes_of(table: DataFrame, prints: DataFrame, text: str, max_bits: int = MAX_BITS, trie_rows: int = TRIE_ROWS, whole: int = WHOLE, pivots: int = PIVOTS) -> DataFrame:
    """(node, root) of the nodes with links, root the least node of the class."""
    rows = written(tries(prints, trie_rows), "tries")
    table = in_tries(rows, table, prints, text)
    first = written(first_links(rows, max_bits, whole, pivots), "first")
    roots = components(compared(first, table, prints, text))
    rest = written(links_across(rows, roots, table, prints, text, max_bits, whole).join(first.hint("merge"), ["a", "b"], "left_anti"), "rest")
    if rest.isEmpty():
        return roots
    more = compared(rest, table, prints, text)
    return roots if more.isEmpty() else components(roots.toDF("a", "b").unionByName(more))


def sketched(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Written tables: rows (row, id, uid, node, n, fp, bands), and nodes (node, first, n, fp, bands), one per set of shingles."""
    found = packed(docs, id=F.col(doc_id).cast("long"), found=_sketches(F.col(text)))
    table = written(found.select("row", "id", F.monotonically_increasing_id().alias("uid"), "found.*"), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid"))
    prints = written(table.groupBy("node").agg(first.alias("first"), *[F.any_value(c).alias(c) for c in ("n", "fp", "bands")]), "prints")
    return table, prints


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS, trie_rows: int = TRIE_ROWS, whole: int = WHOLE, pivots: int = PIVOTS) -> DataFrame:
    """The row of the least id of each class (of rows alike in id, any one); columns as in docs.

    Null ids rank last; null and blank texts have no shingle and are one class; texts
    of fewer than five words are alike only if their words are equal. Sets are told
    apart by 64 bits of hash. An empty table gives an empty table. Copies of one text
    are one node, however many; of a family of unlike texts that agree in a band, a task
    holds trie_rows at once, and there are as many tasks as pairs of its chunks.
    """
    table, prints = sketched(docs, text, doc_id)
    roots = classes_of(table, prints, text, max_bits, trie_rows, whole, pivots)
    classes = written(prints.select("node", "first").join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root")), "classes")
    keep = written(classes.groupBy("root").agg(F.min("first").alias("least")).select(F.col("least.uid").alias("uid")), "keep")
    # whole rows are shuffled at every size, so that the disk needed is in proportion to the input
    return table.join(keep.hint("merge"), "uid", "left_semi").select("row.*")
