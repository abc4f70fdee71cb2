"""Fingerprints: the contract's fields by brute force, consistency of the parse, hard rows."""

import hashlib
import random

import numpy as np

from spoor.llm import fingerprints as fp


def edited(rows):
    """rows of (doc_id, text) with distinct ids -> {doc_id: (n_chars, sha of the edited text, edited text, next text)}"""
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    out = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        c = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        out[i] = (len(t), hashlib.sha256(c.encode()).hexdigest(), c, n)
    return out


def check(spark, rows, df):
    wanted = edited(rows)
    got = {r.doc_id: r for r in df.collect()}
    assert set(got) == set(wanted)
    texts = dict(rows)
    for i, (n, sha, c, after) in wanted.items():
        r = got[i]
        own, other, nxt = fp.fingerprints([texts[i] or "", c, after])
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha, own, other)
        assert (r.near_edited, r.near_next) == (fp.likeness(own, other), fp.likeness(own, nxt))
    return got


def test_given_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    monkeypatch.setattr(fp, "ROWS", 60)
    got = check(spark, [(r.doc_id, r.text) for r in docs.collect()], fp.fingerprint_digests(docs))
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)
    assert 0.2 < np.mean([r.near_edited for r in long]) < 0.5 and np.mean([r.near_next for r in long]) < 0.1


def test_hard_rows(spark):
    rows = [(5, None), (3, ""), (9, "a"), (10, "aé日𝄞" * 3), (-4, "x" * 5000), (77, "ab" * 3000), (78, "long " * 100_000)]
    schema = "doc_id long, text string, fingerprint int, range string"
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], schema)
    got = check(spark, rows, fp.fingerprint_digests(docs))
    assert got[5].fingerprint == got[3].fingerprint == "" and got[5].near_edited == 1.0
    check(spark, rows[2:3], fp.fingerprint_digests(docs.filter("doc_id = 9")))
    assert fp.fingerprint_digests(docs.filter("doc_id = 1")).collect() == []
    twice = fp.fingerprint_digests(spark.createDataFrame([(1, "b"), (1, "a"), (None, "abc")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in twice) == [("1", 1), ("1", 1), ("None", 3)]


def test_equal_substrings_share_interior_names():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcde fghi") for _ in range(n))
    with np.errstate(over="ignore"):
        for _ in range(10):
            common, a, b = text(3000), text(rng.randrange(200)), text(rng.randrange(200))
            names = []
            for t in (a + common, common + b):
                x, bounds = np.array([ord(c) for c in t], np.uint64), np.array([0, len(t)])
                for _ in range(3):
                    x, bounds = fp.level_up(x, bounds)
                names.append(list(x))
            shared = len(set(names[0]) & set(names[1]))
            assert shared > 0.85 * min(map(len, names)) * 3000 / 3200
            assert max(map(len, names)) < 3200 / 8
