"""Ranked search against brute force, the stopping rule, hard rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from spoor.llm import ranked
from tests.llm.brute import LOWER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n_docs, length = len(terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, t in terms:
            tf, m = Counter(t), 100 - 90 + (90 * len(t) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in wanted if tf[x])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(ranked, "SHARD_ROWS", 40)
    monkeypatch.setattr(ranked, "TERMS", 6)
    rng = random.Random(2)
    word = lambda: rng.choice(["as", "the", "Été", "x1", "ab-cd", "Ab", "日本", "a_b", "İ", "\x00", "\x7f", "q" * 30])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 25)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "as " * 30_000), (None, "x1 the x1"), (203, docs[5][1]), (203, docs[6][1]), (204, docs[5][1]),
             *[(300 + i, "same words in many rows") for i in range(60)], (-5, "same words in many rows")]
    items = [(1, "The AS as x1"), (2, "été 日本 q"), (3, None), (4, ""), (5, "nowhere"), (6, "same rows"), (6, "x1"), (None, "as"), (7, "q" * 30 + "\x7fab")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n int, shard int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, term int")
    assert got(ranked.ranked(frame, asked)) == brute(docs, items)
    assert got(ranked.ranked(frame.filter("doc_id < -9"), asked)) == got(ranked.ranked(frame, asked.filter("item_id > 99"))) == []


def test_stops_early_and_loses_none():
    rng = np.random.default_rng(4)
    n, kinds = 6000, 400
    texts = [np.unique(rng.zipf(1.3, rng.integers(5, 80)) % kinds) for _ in range(n)]
    sizes = np.array([len(t) for t in texts])
    terms = np.concatenate(texts).astype(np.int32)
    factor = rng.integers(1, 60, len(terms)).astype(np.int32) * 1000
    shard = ranked.Shard(ranked.build_shard(np.arange(n) * 3, sizes, terms, factor))
    weight = np.floor(1000 * np.log(n / np.bincount(terms, minlength=kinds).clip(1))).astype(np.int64)
    doc, total, read = np.repeat(np.arange(n), sizes), 0, 0
    for _ in range(40):
        item = np.unique(rng.integers(0, kinds, 5))
        before = shard.read
        ids, scores = shard.best(item, weight[item])
        read += shard.read - before
        mine = np.isin(terms, item)
        total += mine.sum()
        every = np.bincount(doc[mine], weight[terms[mine]] * factor[mine], n).astype(np.int64)
        order = np.lexsort((np.arange(n), -every))[:10]
        assert ids.tolist() == (order * 3)[every[order] > 0].tolist() and scores.tolist() == every[order][every[order] > 0].tolist()
        again, _ = shard.best(item, weight[item], floor=int(scores[4]) + 1)
        assert again.tolist() == ids[scores > scores[4]].tolist()
    assert read < 0.5 * total and not shard.seen.any() and not shard.met.any()
