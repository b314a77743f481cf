"""The near-duplicate stage of the pipeline: against all pairs of shingle sets."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from sedra.llm import similar, simhash
from sedra.llm.graph import components
from sedra.llm.shared import written


def five(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept_by_hand(data):
    sets, parent = [five(t) for _, t, _ in data], list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, *_) in enumerate(data):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return set(least.values())


def test_near_copies_beyond_simhash(spark, docs_of):
    """Copies with changed words, chains of copies and near misses; the 4-bit links of op4 leave many of them apart."""
    rng = random.Random(7)
    data = []
    for _ in range(30):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(40, 200))]
        for _ in range(8):
            data.append((len(data), " ".join(words), "a"))
            for at in rng.sample(range(len(words)), rng.choice((1, 1, 2, 3))):
                words[at] = f"v{rng.randint(0, 3000)}"
    docs = docs_of(data)
    want = kept_by_hand(data)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == want
    assert simhash.deduplicated(docs).count() > len(want)


def test_large_group(spark, docs_of):
    """A group in which not every pair is alike, exact copies, blanks and short texts."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    data = [(0, "", "a"), (1, " \t", "a"), (2, "one two", "a"), (3, "One  two", "a"), (4, "one two three", "a")]
    for _ in range(150):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((0, 1, 1, 2, 3, 5))):
            words[at] = f"x{rng.randint(0, 10**6)}"
        data.append((len(data), " ".join(words), "a"))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(data), "").collect()} == kept_by_hand(data)
    assert corpus_pipeline.near_duplicates(spark, docs_of(data).limit(0), "").count() == 0


def test_pairs_across_classes():
    """All pairs of unlike roots within the budget, equal keys included, and none of one root."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    keys = rng.choice(centres, 400) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    frame = pd.DataFrame({"key": keys.view(np.int64), "trie": rng.integers(-2, 3, 400), "root": rng.integers(0, 9, 400)})
    frame = frame.iloc[np.lexsort((keys, frame["trie"]))]
    got = [(i, j) for a, b in simhash.across(frame, 3) for i, j in zip(a.tolist(), b.tolist())]
    rows = list(frame.itertuples(index=False))
    want = {
        (i, j)
        for j, y in enumerate(rows)
        for i, x in enumerate(rows[:j])
        if x.trie == y.trie and x.root != y.root and ((x.key ^ y.key) & (2**64 - 1)).bit_count() <= 3
    }
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_large_tries_lose_no_link(spark, docs_of):
    """Variants of one text, each with near copies, whichever tries count as large; the walk across classes alone finds all links, and none within a class."""
    rng = random.Random(9)
    base, data = [f"w{i}" for i in range(200)], []
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(200), 5):
            words[at] = f"x{rng.randint(0, 10**6)}"
        for _ in range(2):
            data.append((len(data), " ".join(words), "a"))
            for at in rng.sample(range(200), 4):
                words[at] = f"y{rng.randint(0, 10**6)}"
    want, docs = kept_by_hand(data), docs_of(data)
    for whole, pivots in ((1, 0), (32, 4)):
        assert {r.doc_id for r in similar.deduplicated(docs, whole=whole, pivots=pivots).collect()} == want
    table, prints = similar.sketched(docs)
    rows, alone = written(similar.tries(prints), "tries"), spark.createDataFrame([], "node long, root long")
    links = similar.links_across(rows, alone, table, prints, "text", similar.MAX_BITS, 1)
    assert prints.count() - components(similar.compared(links, table, prints, "text")).count() == len(want)
    roots = written(prints.select("node", F.lit(0).cast("long").alias("root")), "roots")
    assert similar.links_across(rows, roots, table, prints, "text", similar.MAX_BITS, 1).isEmpty()


def test_samples_keep_all_that_are_alike():
    """Whole and cut samples of sets, from unlike to equal."""
    rng = np.random.default_rng(4)
    for n in (1, 20, 150, 3000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets = [np.unique(np.where(rng.random(n) < share, rng.integers(0, 1 << 63, n, dtype=np.uint64), base)) for share in np.linspace(0, 0.5, 40)]
        samples = similar._Samples([np.unique((x >> np.uint64(32)).astype(np.uint32))[: similar.LEAST].tobytes() for x in sets])
        i, j = np.triu_indices(40, 1)
        likely = samples.likely(i, j)
        near = np.array([similar.alike(sets[a], sets[b]) for a, b in zip(i, j)])
        assert likely[near].all() and (n == 1 or likely.sum() < near.sum() * 2 + 40)


def test_every_pair_of_an_overfull_trie_meets(spark):
    """Nodes that agree in one band only, more than a trie may hold: each two are in one trie, and no trie holds much more than it may."""
    data = [(i, 100, i, [-1] + [1000 * i + k for k in range(1, 32)]) for i in range(100)]
    prints = spark.createDataFrame(data, "node long, n long, fp long, bands array<long>")
    groups = {}
    for r in similar.tries(prints, trie_rows=20).collect():
        groups.setdefault(r.trie, set()).add(r.node)
    assert {(a, b) for g in groups.values() for a in g for b in g if a < b} == {(a, b) for b in range(100) for a in range(b)}
    assert max(map(len, groups.values())) < 50


def test_overfull_tries_lose_no_link(spark, docs_of):
    """Pairs of long texts that are alike, all with one passage: more than a trie may hold, and few agree in a second band."""
    rng = random.Random(10)
    data = []
    for _ in range(40):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(60)] + [f"c{i}" for i in range(60)]
        for _ in range(2):
            data.append((len(data), " ".join(words), "a"))
            words[rng.randint(10, 50)] = f"y{rng.randint(0, 10**6)}"
            words[rng.randint(70, 110)] = f"y{rng.randint(0, 10**6)}"
    want = kept_by_hand(data)
    assert {r.doc_id for r in similar.deduplicated(docs_of(data), trie_rows=4).collect()} == want and len(want) < len(data)


def test_cut_samples_are_never_dropped_by_an_estimate():
    """Sets that are alike while their least 1024 hashes are not; unlike ones still go."""
    sets = [2 * np.arange(1, 3001), 2 * np.arange(1, 3001), 2 * np.arange(5000, 8000)]
    sets[1][:1024:4] += 1
    sets = [x.astype(np.uint64) << np.uint64(32) for x in sets]
    samples = similar._Samples([(x >> np.uint64(32)).astype(np.uint32)[: similar.LEAST].tobytes() for x in sets], np.full(3, 3000))
    assert similar.alike(sets[0], sets[1])
    assert samples.likely(np.array([0, 0, 1]), np.array([1, 2, 2])).tolist() == [True, False, False]
