"""SimHash near-duplicates by a self-join of binary tries of fingerprints.

Copies share a fingerprint, so the join runs over distinct fingerprints. Within
max_bits differing bits of 64, one of max_bits + 1 blocks of bits is equal; the
fingerprints are rotated so that each block in turn leads, and those equal in the
leading block form one trie. A trie of too many rows is dealt again by blocks of
the bits that follow, as one of those must be equal too. In a trie, pairs of nodes
are walked together from the root: a pair carries the bits in which its prefixes
differ, and goes once they are above the budget. Pairs whose nodes already hang
together are left out, so that a dense cluster costs its links to become
connected, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .graph import components
from .shared import groups_for, packed, written

WORDS, SEED = 4, 42
#: A walk holds at most so many node pairs at once.
FRONTIER = 1 << 19


def simhash(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer.

    A-Z are lower-cased, words are joined in shingles of four; fewer words are one
    shingle, none give zero. A bit is set if it is set in over half the hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six blanks only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - WORDS + 1)
    return majority([digest(b" ".join(words[i : i + WORDS]), SEED) for i in range(at, min(n, at + (1 << 16)))] for at in range(0, n, 1 << 16))


def majority(parts: Iterable) -> int:
    """Signed 64-bit integer of the bits set in over half of all hashes, which come in parts; zero if there are none."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for few in parts:
        bits = np.unpackbits(np.array(few, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int64)
        n += len(few)
    return int(np.packbits(votes * 2 > n).view(">i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprinted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: bool = True) -> DataFrame:
    """Written table of struct `row` (if carry), `id`, `uid` (one per row) and `fp`."""
    out = packed(docs, id=F.col(doc_id).cast("long"), fp=_fingerprints(F.col(text)))
    out = out.withColumn("uid", F.monotonically_increasing_id())
    return written(out if carry else out.drop("row"), "fingerprints")


class _Trie:
    """The sorted rows of several tries, and who hangs together so far."""

    def __init__(self, keys: np.ndarray, listed: np.ndarray, root: np.ndarray | None = None):
        """listed: rows of tries whose links are all wanted, so that none of them count as hanging together; root: who does already."""
        self.keys, self.ones, self.listed = keys, {}, listed
        self.root = np.arange(len(keys)) if root is None else root
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.touch()

    def touch(self) -> None:
        self.steps = np.concatenate(([0], np.cumsum(self.root[1:] != self.root[:-1])))

    def split(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where in [lo, hi) the bit at this depth becomes one."""
        if depth not in self.ones:
            bit = (self.keys >> np.uint64(63 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
        return hi - (self.ones[depth][hi] - self.ones[depth][lo])

    def open(self, p: np.ndarray) -> np.ndarray:
        """Pairs whose nodes don't all hang together already."""
        alo, ahi, blo, bhi = p[:4]
        s = self.steps
        return p[:, ~((s[ahi - 1] == s[alo]) & (s[bhi - 1] == s[blo]) & (self.root[alo] == self.root[blo]))]

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Hooks the larger root of each pair to the smaller; `links` keeps the one pair that each hook is due to."""
        root = self.root
        if self.listed.any():
            all_ = self.listed[i]
            self.links.append((i[all_ & (i != j)], j[all_ & (i != j)]))
            i, j = i[~all_], j[~all_]
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, one = np.unique(np.maximum(a, b), return_index=True)
            root[high] = np.minimum(a, b)[one]
            self.links.append((i[one], j[one]))
            while not np.array_equal(up := root[root], root):
                root[:] = up
        self.touch()

    @staticmethod
    def leaves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows i < j of pairs of leaves, which hold more than one row where keys are equal."""
        alo, ahi, blo, bhi = pairs[:4]
        each = (ahi - alo) * (bhi - blo)
        of = np.repeat(np.arange(len(each)), each)
        k = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        wide = (bhi - blo)[of]
        i, j = alo[of] + k // wide, blo[of] + k % wide
        return i[i < j], j[i < j]

    def walk(self, start: int, lo: np.ndarray, hi: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j) within max_bits, as they are met; lo, hi: bounds of the tries in the rows, all rows of one agree in their first `start` bits."""
        many = hi - lo > 1
        stack = [(start, np.stack([lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), dtype=np.int64)]))]
        while stack:
            depth, pairs = stack.pop()
            if pairs.shape[1] > FRONTIER:
                stack += [(depth, x) for x in np.array_split(pairs, 2, axis=1)]
                continue
            pairs = self.open(pairs)
            if not pairs.shape[1]:
                continue
            if depth == 64:
                yield self.leaves(pairs)
                continue
            alo, ahi, blo, bhi, bits = pairs
            amid, bmid = self.split(depth, alo, ahi), self.split(depth, blo, bhi)
            same = (alo == blo) & (ahi == bhi)
            apart, more = ~same, bits + 1
            after = [np.stack([alo, amid, blo, bmid, bits]), np.stack([amid, ahi, bmid, bhi, bits]), np.stack([alo, amid, bmid, bhi, more]), np.stack([amid, ahi, blo, bmid, more])[:, apart]]
            after = np.concatenate(after, axis=1)
            full = (after[1] > after[0]) & (after[3] > after[2]) & (after[4] <= max_bits)
            lone = (after[0] == after[2]) & (after[1] == after[3]) & (after[1] - after[0] == 1)
            stack.append((depth + 1, after[:, full & ~lone]))


def walked(frame: pd.DataFrame, max_bits: int, whole: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows (node, key, trie, lead) of several tries -> nodes (a, b) of links within max_bits, each of which joined two classes of its trie.

    Keys of one trie agree in their first `lead` bits; nodes of equal keys in one
    trie are linked to the first of them. Tries of at most `whole` rows give all
    their links.
    """
    frame = frame.assign(key=frame["key"].to_numpy().view(np.uint64)).sort_values(["lead", "trie", "key", "node"])
    node, keys, names, lead = (frame[c].to_numpy() for c in ("node", "key", "trie", "lead"))
    apart = (names[1:] != names[:-1]) | (lead[1:] != lead[:-1])
    first = np.append(True, apart | (keys[1:] != keys[:-1]))
    few = np.bincount(np.cumsum(np.append(0, apart)))
    first |= np.repeat(few <= whole, few)
    run = np.cumsum(first) - 1
    same = node[~first], node[first][run[~first]]
    node, keys, names, lead = node[first], keys[first], names[first], lead[first]
    head = keys >> (64 - lead).astype(np.uint64) if lead.any() else np.zeros(len(keys), dtype=np.uint64)
    edges = np.flatnonzero((head[1:] != head[:-1]) | (names[1:] != names[:-1]) | (lead[1:] != lead[:-1])) + 1
    lo, hi = np.append(0, edges), np.append(edges, len(keys))
    trie = _Trie(keys, np.repeat(hi - lo <= whole, hi - lo))
    for start in np.unique(lead).tolist():
        here = lead[lo] == start
        for i, j in trie.walk(start, lo[here], hi[here], max_bits):
            trie.link(i, j)
    a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *[x[k] for x in trie.links]]) for k in (0, 1))
    return np.append(same[0], node[a]), np.append(same[1], node[b])


def across(frame: pd.DataFrame, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (key, trie, root) of several tries, in order of both -> every pair of rows within max_bits that have unlike roots, in parts."""
    keys, names = frame["key"].to_numpy().view(np.uint64), frame["trie"].to_numpy()
    root = np.unique(frame["root"].to_numpy(), return_inverse=True)[1]
    edges = np.flatnonzero(names[1:] != names[:-1]) + 1
    trie = _Trie(keys, np.zeros(len(keys), dtype=bool), root)
    for i, j in trie.walk(0, np.append(0, edges), np.append(edges, len(keys)), max_bits):
        apart = root[i] != root[j]
        yield i[apart], j[apart]


def _dealt(rows: DataFrame, lead: int, blocks: int) -> DataFrame:
    """(fp, key, trie), tries equal in their first `lead` bits -> each row once per block of the rest, rotated so that the block follows."""
    rest = 64 - lead
    width, low = rest // blocks, F.lit((1 << rest) - 1 if lead else -1)
    keys = [F.col("key")]
    for t in range(1, blocks):
        tail = F.col("key").bitwiseAND(low)
        turned = F.shiftleft(tail, t * width).bitwiseOR(F.shiftrightunsigned(tail, rest - t * width)).bitwiseAND(low)
        keys.append(F.col("key").bitwiseAND(F.bitwise_not(low)).bitwiseOR(turned))
    names = [F.xxhash64("trie", F.lit(t), F.shiftrightunsigned(k, rest - width)) for t, k in enumerate(keys)]
    return rows.select("fp", F.inline(F.array(*[F.struct(k.alias("key"), n.alias("trie")) for k, n in zip(keys, names)])))


def tries(prints: DataFrame, max_bits: int = 4, trie_rows: int = 1 << 16) -> DataFrame:
    """Distinct fingerprints `fp` -> (fp, key, trie, lead): two within max_bits meet in a trie, whose keys agree in `lead` bits.

    A block of bits that a third of all fingerprints agree in is no task of its
    own: tries of over trie_rows rows are dealt again until none is left, or until
    so few bits remain that they bound a trie. Nothing is dropped on the way.
    """
    blocks, lead, ready = max_bits + 1, 0, []
    rows = prints.select("fp", F.col("fp").alias("key"), F.lit(0).cast("long").alias("trie"))
    while True:
        rows = _dealt(rows, lead, blocks)
        lead += (64 - lead) // blocks
        named = rows.withColumn("lead", F.lit(lead))
        if 64 - lead < blocks or 1 << (64 - lead) <= trie_rows:
            return reduce(DataFrame.unionByName, ready, named)
        hot = written(rows.groupBy("trie").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > trie_rows).select("trie"), "hot")
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, ready, named)
        ready.append(named.join(hot, "trie", "left_anti"))
        rows = written(rows.join(hot, "trie", "left_semi"), "hot-rows")


def near_links(prints: DataFrame, max_bits: int = 4, group_rows: int = 8192, trie_rows: int = 1 << 16) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` within max_bits of each other.

    Not every pair is listed, but two within max_bits are always connected by
    those of one trie. Tries are dealt to groups of about group_rows rows by hash;
    the number of groups follows the number of rows.
    """
    rows = tries(prints, max_bits, trie_rows)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("trie"), F.lit(groups_for(rows.count(), group_rows))))

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip("ab", walked(frame.assign(node=frame["fp"]), max_bits))))

    return rows.groupBy("part").applyInPandas(link, "a long, b long")


def clustered(table: DataFrame, max_bits: int = 4) -> DataFrame:
    """fingerprinted() -> per fingerprint: fp, component_id (least id reachable), keeper (uid of the row that stays).

    Fingerprints with a third of all rows are summed partially and are one row here.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid"))
    prints = written(table.groupBy("fp").agg(first.alias("first")), "prints")
    roots = components(near_links(prints, max_bits)).withColumnRenamed("node", "fp")
    prints = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    prints = written(prints, "rooted")
    # written, so that the join deals both sides anew and can split a class of many fingerprints
    firsts = written(prints.groupBy("root").agg(F.min("first").alias("least")), "firsts")
    out = prints.join(firsts, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.uid").alias("keeper"))
    return written(out, "clusters")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id.

    component_id is the least id reachable over links of at most max_bits bits,
    itself included; null ids rank last, and a class without ids has null. Null
    and blank texts have fingerprint zero and link like any other. Repeated rows
    stay, with one class. An empty table gives an empty table.
    """
    table = fingerprinted(docs, text, doc_id, carry=False)
    return table.join(clustered(table, max_bits), "fp").select(F.col("id").alias(doc_id), "fp", "component_id")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = 4) -> DataFrame:
    """The row of the least id of each class (of rows alike in id, any one); columns as in docs."""
    table = fingerprinted(docs, text, doc_id)
    keep = clustered(table, max_bits).select(F.col("keeper").alias("uid")).distinct()
    return table.join(keep, "uid", "left_semi").select("row.*")


def hamming_links(prints: Iterator[int], max_bits: int = 4) -> list[tuple[int, int]]:
    """All links by comparing every pair: for tests only."""
    p = sorted(set(prints))
    return [(a, b) for i, a in enumerate(p) for b in p[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits]
