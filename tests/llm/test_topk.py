"""Top-k search against brute force; hard rows."""

import random

import numpy as np

from spoor.llm import topk


def brute(rows, every, k):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_hard_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (350, [None] * 6), (400, [float("nan")] * 6), (401, [float("inf")] * 6), (402, [1.0]), (403, []), (450, [0.1] * 6)]
    rows += [(500, [0.0] * 6), (501, [1.0] * 6), (501, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, v int")
    assert got(topk.embedding_search(df)) == brute(rows, 50, 5)
    assert got(topk.embedding_search(df.filter("vec_id in (0, 7)"))) == brute([r for r in rows if r[0] in (0, 7)], 50, 5)
    assert got(topk.embedding_search(df.filter("vec_id < 0"))) == []


def test_bounds_leave_few_and_lose_none():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(4000, 16))).astype(np.int64)
    q = np.concatenate([v[:20] * 3, np.zeros((1, 16), np.int64)])
    own = np.zeros((21, 4000), bool)
    own[np.arange(20), np.arange(20)] = True
    some = topk.candidates(q, v, own, 5)
    for i, c in enumerate(some):
        score = np.where(own[i], np.iinfo(np.int64).min, v @ q[i])
        assert set(np.flatnonzero(score >= np.sort(score)[-5])) <= set(c)
    assert np.mean([len(c) for c in some[:20]]) < 1000
