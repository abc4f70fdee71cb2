"""N-best segmentations against brute force, round trips, hard rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from spoor.llm import pieces
from tests.llm.test_text import thue_morse

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(MODEL)


def every(vocabulary, s):
    """The scores and ids of all segmentations."""
    ending, _ = vocabulary.edges(s)
    ways = [[(0.0, ())]]
    for j in range(1, len(s) + 1):
        ways.append([(a + score, x + ids) for i, score, ids in ending[j] for a, x in ways[i]])
    return sorted(ways[-1], reverse=True)


def test_best_segmentations(vocabulary):
    rng = random.Random(1)
    for _ in range(150):
        s = "".join(rng.choice([" ", "t", "h", "e", "a", "n", ".", "é", "\n", "日"]) for _ in range(rng.randrange(0, 11)))
        all_ways = every(vocabulary, s)
        found = vocabulary.best(s, 6)
        score, loss, ids = vocabulary.leading(s)
        assert np.isclose(score, all_ways[0][0]) and any(i == tuple(ids) and np.isclose(x, score) for x, i in all_ways)
        assert np.isclose(score - loss, all_ways[1][0]) if len(all_ways) > 1 else loss == np.inf
        assert np.allclose([x for x, _ in found], [x for x, _ in all_ways[:6]])
        assert len(set(found)) == len(found) and all(any(i == j and abs(x - y) < 1e-6 * abs(x) + 1e-9 for y, j in all_ways) for x, i in found)


def test_texts(spark, vocabulary):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["the", "an", " ", "  ", "x.", "é", "\n"]) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a▁b"), (103, "a▁b")]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, ids int")
    found = pieces.encoded(docs, MODEL)
    for (i, t), r in zip(sorted(rows, key=lambda x: x[0]), sorted(found.collect(), key=lambda r: r.doc_id)):
        assert r.doc_id == i and r.decodes
        if t and i != 103 and len(t) < 12:
            ways = every(vocabulary, " " + t)
            assert np.allclose(r.scores, [x for x, _ in ways[:4]]) and r.best_score == pytest.approx(ways[0][0])
            assert r.sizes[0] == len(r.ids) and (len(ways) == 1 or ways[0][0] > ways[1][0]) <= (tuple(r.ids) == ways[0][1])
    assert {(r.doc_id, r.text) for r in pieces.decoded(found, MODEL).collect()} == {(i, t or "") for i, t in rows}
    assert pieces.encoded(docs.filter("doc_id = -1"), MODEL).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pieces.encoded(docs, MODEL)
    assert rows.filter("NOT decodes").count() == 0 and rows.count() == 1000
    back = pieces.decoded(rows, MODEL).join(docs.withColumnRenamed("text", "own"), "doc_id")
    assert back.filter("text <> own").count() == 0


def test_combined():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 6))
        losses = np.sort(rng.integers(0, 6, (n, 3)).astype(float), axis=1)
        losses[:, 0] = 0
        losses[rng.random((n, 3)) < 0.2] = np.inf
        losses[:, 0] = 0
        losses.sort(axis=1)
        sums = np.zeros(1)
        for row in losses:
            sums = (sums[:, None] + row[None, :]).reshape(-1)
        wanted = [x for x in np.sort(sums)[:4] if np.isfinite(x)]
        second = losses[:, 1]
        assert [x for x, _ in pieces.combined(second, lambda r: [(x, 0) for x in losses[r] if np.isfinite(x)], 4)] == wanted


def test_every_way_is_given_back(spark, vocabulary):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["the", "an", " ", "x.", "é", "日", "\n", "in"]) for _ in range(rng.randrange(1, 5)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "the " * 400 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spelled = lambda ids: b"".join(vocabulary.bytes_of[i] for i in ids).decode()
    sums, texts = {}, dict(rows)
    for r in pieces.encoded(docs, MODEL).collect():
        text = texts[r.doc_id] or ""
        found = [tuple(w) for w in r.ways]
        assert list(found[0]) == r.ids and [len(w) for w in found] == r.sizes and len(found) == len(r.scores) == len(set(found))
        assert r.ways_decode == [True] * len(found) and all(spelled(w) == (" " + text if text else "") for w in found)
        if text and len(text) < 12:
            every_score = {ids: score for score, ids in every(vocabulary, " " + text)}
            assert len(found) == min(4, len(every_score)) and np.allclose([every_score[w] for w in found], r.scores)
            assert np.allclose(r.scores, sorted(every_score.values(), reverse=True)[:4])
        sums[r.doc_id] = [zlib.crc32(np.array(w, "<u4").tobytes()) for w in found]
    assert sums[100] == sums[101] == [0] and len(sums[102]) == 4
    short = pieces.encoded(docs, MODEL, keep_ids=False).collect()
    assert {r.doc_id: r.ways_crc32 for r in short} == sums and all(r.ids_crc32 == r.ways_crc32[0] for r in short)


def test_stretches_made_to_collide_in_polynomials(spark):
    rows = list(enumerate(thue_morse()))
    found = pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string"), MODEL)
    assert [r.decodes for r in found.collect()] == [True, True]
    assert {r.doc_id: r.text for r in pieces.decoded(found, MODEL).collect()} == dict(rows)
