"""The pipeline, stage by stage, against plain Python on what each stage got; and over an empty table."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_documents import DATA, WORD, measures, pii_base, prose, targets

import corpus_pipeline
from sedra.llm import packing, pii

NOISY = [(300 + i, prose(60) + " ###" * 12 + f" end {i}", "noisy") for i in range(12)]
BASE, EDITED = [f"v{i}" for i in range(90)], [f"w{i}" for i in range(150)]
COPIES = [(400 + i, " ".join(w + "x" * (k == 7 * i) for k, w in enumerate(BASE)), "copies") for i in range(3)]
EDITS = [(500 + i, " ".join(EDITED[: 20 * i] + ["new"] + EDITED[20 * i :]), "edits") for i in range(5)]
ROWS = [*DATA, *NOISY, *COPIES, *EDITS]


@pytest.fixture(scope="module")
def stages(docs_of, spark, tmp_path_factory):
    """What each stage got and gave, as lists of rows."""
    folder = f"file://{tmp_path_factory.mktemp('pipeline')}"
    docs_of(ROWS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen, out = docs.columns, docs.collect(), []
    for name, stage in corpus_pipeline.STAGES:
        corpus_pipeline.shared.written(stage(spark, docs, folder), name).write.parquet(at := f"{folder}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(at)
        if name != "packing":
            assert docs.columns == columns
        got = docs.collect()
        out.append((seen, got))
        seen = got
    return folder, out


def as_counts(rows):
    return Counter((r.doc_id, r.text, r.source) for r in rows)


def test_quality(stages):
    seen, got = stages[1][0]
    rules = {}
    for r in seen:
        n, chars, symbols, lines, again, repeats = measures(r.text)
        soft = (10 * symbols > n, 100 * again > 30 * lines, chars > 12 * n or chars < 2 * n)
        rules[id(r)] = (n < 20 or 100 * repeats > 30 * n, soft)
    enforced = Counter()
    for k in range(3):
        hosts = {s: [rules[id(r)][1][k] for r in seen if r.source == s] for s in {r.source for r in seen}}
        mean = sum(map(sum, hosts.values())) / len(seen)
        spread = np.var([sum(h) / len(h) for h in hosts.values()])
        weight = max(1.0, min(1e4, mean * (1 - mean) / spread - 1 if spread > 0 else 1e4))
        for s, h in hosts.items():
            enforced[s, k] = (sum(h) + mean * weight) / (len(h) + weight) > 0.5
    want = [r for r in seen if not rules[id(r)][0] and not any(rules[id(r)][1][k] and enforced[r.source, k] for k in range(3))]
    assert as_counts(got) == as_counts(want) and enforced["noisy", 0]


def test_near_copies(stages):
    seen, got = stages[1][1]
    sets = []
    for r in seen:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(r.text or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(seen)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    best = {}
    for i, r in enumerate(seen):
        order = (r.doc_id is None, r.doc_id or 0)
        best[root[i]] = min(order, best.get(root[i], order))
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(None if null else x) for null, x in best.values())
    assert not as_counts(got) - as_counts(seen)
    assert [sum((r.doc_id or 0) >= 500 for r in x) for x in (seen, got)] == [5, 1]


def test_personal_data(stages):
    seen, got = stages[1][2]
    want = Counter()
    for r in seen:
        text = r.text
        while text and (spans := pii_base(text) + [s for s in pii.find_spans(text) if s[0] not in pii.BASE_KINDS]):
            text = pii.redact(text, spans)
        want[r.doc_id, text, r.source] += 1
    assert as_counts(got) == want and all(r.n_chars == len(r.text) for r in got)
    assert not any(pii_base(r.text) for r in got) and any("<EMAIL>" in r.text for r in got)


def test_mixture(stages):
    seen, got = stages[1][3]
    size = lambda r: len(WORD.findall(r.text or ""))
    sizes, taken = Counter(), Counter()
    for r in seen:
        sizes[r.source] += size(r)
    for r in got:
        taken[r.source] += size(r)
    assert not as_counts(got) - Counter({k: 2 * n for k, n in as_counts(seen).items()})
    for s, want in targets(sizes).items():
        assert abs(taken[s] - want) <= 2 * max(size(r) for r in seen if r.source == s)


def test_packing(stages):
    from tokenizers import Tokenizer

    seen, got = stages[1][4]
    whole = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in seen:
        ids = np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [packing.END], dtype="<u4")
        want.update((r.doc_id, at, ids[at : at + packing.SEQUENCE].tobytes()) for at in range(0, len(ids), packing.SEQUENCE))
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in got) == want
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= packing.SEQUENCE


def test_run_is_its_stages(spark, stages):
    folder, out = stages
    pieces = lambda rows: Counter((r.doc_id, r.start, r.length, r.doc_tokens, bytes(r.ids)) for r in rows)
    assert pieces(corpus_pipeline.run(spark, folder).collect()) == pieces(out[-1][1])


def test_empty_table(spark, docs_of, tmp_path):
    docs_of(ROWS).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.count() == 0 and "sequence_id" in got.columns
