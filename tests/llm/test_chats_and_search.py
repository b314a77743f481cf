"""Chat collapse and exact search against brute force, and their special cases."""

import random

import numpy as np
from helpers import rows

from sedra.llm import chats, search


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def test_snapshots(spark):
    rng = random.Random(2)
    logs = {}
    for i in range(80):
        base = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "x y", "é"])) for _ in range(rng.randint(1, 5))]
        if logs and rng.random() < 0.5:
            other = rng.choice(list(logs.values()))
            base = other[: rng.randint(1, len(other))] + (base if rng.random() < 0.3 else [])
        logs[i] = base
    data = [(i, k, r, t) for i, turns in logs.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(data)
    want = []
    for i, turns in logs.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in logs.values())
        first = min(j for j, o in logs.items() if o == turns)
        if not longer and first == i:
            want.append((i, len(turns), render(turns)))
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumnRenamed("turn", "turn")
    assert rows(chats.maximal_chats(df), "conv_id", "n_turns", "rendered") == sorted(want)


def test_chat_special_cases(spark):
    schema = "conv_id long, turn long, role string, text string, key int, k int"
    df = spark.createDataFrame([(None, 1, "user", "a", 1, 1), (None, 2, "user", "b", 1, 1), (1, None, "user", "z", 1, 1), (1, 1, "user", "a", 1, 1), (1, 1, "user", "a", 1, 1)], schema)
    assert rows(chats.maximal_chats(df), "conv_id", "n_turns", "rendered") == [(None, 2, render([("user", "a"), ("user", "b")])), (1, 3, render([("user", "a"), ("user", "a"), ("user", "z")]))]
    assert chats.maximal_chats(df.limit(0)).count() == 0


def test_search(spark):
    import math

    rng = random.Random(3)
    vectors = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    vectors += [(50, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (7, vectors[7][1]), (304, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, v int")
    usable = [(i, [math.floor(256 * x) for x in r.embedding]) for (i, v), r in zip(vectors, df.collect()) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in usable if i % 50 == 0}):
        qv = next(v for i, v in usable if i == q)
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in usable if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    for block in (4096, 40):
        assert rows(search.top_k(df, block=block), "query_id", "rank", "vec_id", "score") == want
    assert search.top_k(df.limit(0)).count() == 0
    assert search.top_k(df.where("vec_id in (50, 100, 101)")).count() == 4  # fewer candidates than k


def test_search_of_large_components(spark):
    """Scores that a long holds although their terms would wrap around narrower sums; what a long can't hold raises."""
    import pytest

    df = spark.createDataFrame([(0, [1e6, 1e6]), (1, [1e6, -1e6]), (2, [2e6, 1.0])], "vec_id long, embedding array<double>")
    got = rows(search.top_k(df), "query_id", "vec_id", "score")
    assert got == [(0, 1, 0), (0, 2, 256 * 10**6 * (512 * 10**6 + 256))]
    for wrong in ([1e15, 1e15], [1e300, 1.0]):
        with pytest.raises(Exception, match="beyond a long"):
            search.top_k(spark.createDataFrame([(0, wrong), (1, wrong)], "vec_id long, embedding array<double>")).collect()
    exact = search.block_scores([np.array([2**62, 2**62])], [np.array([2**62, -(2**62)]), np.array([1, 0])])
    assert exact.tolist() == [[0, 2**62]]


def test_repeated_query_asks_with_its_least_vector(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 0.5])], "vec_id long, embedding array<float>")
    assert rows(search.top_k(df), "rank", "vec_id", "score") == [(1, 2, 256 * 128), (2, 1, 0)]


def test_queries_and_sql_agree(spark):
    """Registered queries against their SQL on the smallest tables."""
    import duckdb

    from sedra.llm.queries import QUERIES, SQL

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name, sql in SQL.items():
        df = QUERIES[name](spark, folder)
        want = con.sql(f"select {', '.join(df.columns)} from ({sql})").fetchall()
        assert sorted(map(str, df.collect())) == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(df.columns, r))})" for r in want), name
