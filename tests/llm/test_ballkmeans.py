"""Codes of ball k-means against the plain method, work saved, hard rows."""

import hashlib
import math
import random

import numpy as np

from spoor.llm import ballkmeans


def brute(rows):
    """rows of (vec_id, vector, label) -> sorted (vec_id, code, error, label_error, sha)"""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8)
    whole = [[math.floor(4096 * x) for x in v] + [0] * (8 * width - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:16]
    books = [[whole[k][p * width:(p + 1) * width] for k in first] for p in range(8)]

    def nearest(p, v):
        d = [(sum((a - b) ** 2 for a, b in zip(v[p * width:(p + 1) * width], e)), j) for j, e in enumerate(books[p])]
        return min(d)
    for _ in range(6):
        new = []
        for p in range(8):
            mine = [nearest(p, v)[1] for v in whole]
            entries = []
            for j, e in enumerate(books[p]):
                held = [v[p * width:(p + 1) * width] for v, m in zip(whole, mine) if m == j]
                entries.append([sum(c) // len(held) for c in zip(*held)] if held else e)
            new.append(entries)
        books = new
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[nearest(p, v) for p in range(8)] for v in whole]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, g), e in zip(kept, errors):
        by[g] = by.get(g, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), e, by[g], sha) for (i, _, g), f, e in zip(kept, found, errors)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(ballkmeans, "BLOCK_ROWS", 40)
    rng = random.Random(6)
    f = lambda: float(np.float32(rng.choice([rng.gauss(0, 1), 0.5, -0.25, 0.0])))
    rows = [(i, [f() for _ in range(16)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(200, None, 1), (201, [None] * 16, 1), (202, [float("nan")] * 16, 1), (203, [float("-inf")] * 16, 2), (204, [], 3), (205, [1.0] * 3, 3),
             (None, [0.5] * 16, 1), (3, [0.25] * 16, 1), (3, [0.25] * 16, 1), (-7, [9.5] * 13, None), (-7, [-0.75] * 16, None)]
    df = spark.createDataFrame([(i, v, g, "c") for i, v, g in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    assert got(ballkmeans.compressed(df)) == brute(rows)
    few = [r for r in rows if r[0] in (1, 2, 200)]
    assert got(ballkmeans.compressed(df.filter("vec_id in (1, 2, 200)"))) == brute(few)
    assert got(ballkmeans.compressed(df.filter("vec_id = 999"))) == []


def test_very_large_components(spark):
    rows = [(i, [float(i) ** 9 * 1e6, -1.5, 3e30 if i == 4 else 2.0], "a") for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    wanted = [(i, c, e if e < 1 << 63 else None, None if g >= 1 << 63 else g, s) for i, c, e, g, s in brute(rows)]
    found = got(ballkmeans.compressed(df))
    assert [r[:3] + r[4:] for r in found] == [r[:3] + r[4:] for r in wanted]


def test_balls_save_work():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = (centres[rng.integers(0, 16, 5000)] + rng.integers(-900, 900, (5000, 8))).astype(float)
    entries = centres.astype(float)
    plain = ((x[:, None] - entries[None]) ** 2).sum(-1)
    code, best, work = ballkmeans.assign(x, np.zeros(5000, np.int64), entries, None)
    assert (code == plain.argmin(1)).all() and (best == plain.min(1)).all()
    again, _, less = ballkmeans.assign(x, code, entries, None)
    still, _, least = ballkmeans.assign(x, code, entries, np.zeros(16, bool))
    assert (again == code).all() and (still == code).all() and least == 5000 <= less < 0.3 * 5000 * 16 and work <= 5000 * 17
