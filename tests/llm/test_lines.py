"""Repeated lines against brute force, the perfect hash, hard rows."""

import hashlib

import numpy as np

from spoor.llm import lines
from tests.llm import brute
from tests.llm.test_text import thue_morse


def wanted(rows):
    return {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in brute.dropped_lines(rows).items()}


def got(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()}


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sizes, slots = lines.perfect_hash(keys)
        assert sorted(lines.positions(keys, sizes, slots)) == list(range(len(keys)))
        others = rng.integers(0, 2**63, 500).astype(np.uint64)
        assert lines.positions(others, sizes, slots).max(initial=-1) < max(1, len(keys))


def test_given_documents(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 500)
    monkeypatch.setattr(lines, "CHUNK_ROWS", 100)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(lines.line_digests(docs)) == wanted([(r.doc_id, r.text) for r in docs.collect()])


def test_hard_rows(spark):
    common, other = "A common line of the corpus", "Ein Zeichen für jede Zeile"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, common), (5, f" {common.upper()}\t\n{other}\n{common}"), (6, f"{common}\nx"),
            (7, other), (8, f"y\n{other}\n\n"), (9, "short\nshort"), (10, "short"), (11, "short"), (12, "é" * 19), (13, "é" * 19), (14, "é" * 19),
            (15, "é" * 20), (16, "é" * 20 + "\x0b"), (17, "é" * 20), (18, f"{common}\n" * 20_000)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "c", i) for i, t in rows], "doc_id long, text string, n_chars long, chunk string, shard long")
    assert got(lines.line_digests(docs)) == wanted(rows)
    kept, texts = brute.dropped_lines(rows), dict(rows)
    left = lines.drop_lines(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        text = kept[r.doc_id][2] if kept[r.doc_id][1] else texts[r.doc_id]
        assert (r.text, r.n_chars) == (text, len(text or ""))


def test_repeated_rows_and_missing_ids(spark):
    line = "the same line in several rows"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line)], "doc_id long, text string")
    rows = sorted((str(r.doc_id), r.n_dropped) for r in lines.line_digests(docs).collect())
    assert rows == [("1", 1), ("1", 1), ("2", 0), ("None", 0)]
    assert lines.line_digests(docs.filter("doc_id = 9")).collect() == [] and lines.drop_lines(docs.filter("doc_id = 9")).collect() == []


def test_rows_of_one_id_are_answered_by_their_own_text(spark):
    line, other = "the same line in several rows", "another line in several rows"
    rows = [(1, f"{line}\nx"), (1, f"{other}\ny"), (1, "z"), (2, f"{other}\n{line}"), (3, f"{line}\n{other}")]
    docs = spark.createDataFrame([*rows, *[(None, line)] * 50], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in lines.line_digests(docs).filter("doc_id IS NOT NULL").collect()) == [
        (1, 0), (1, 1), (1, 1), (2, 2), (3, 0)]
    assert sorted((r.doc_id or 0, r.text) for r in lines.drop_lines(docs).collect()) == sorted(
        [(0, line)] * 50 + [(1, "x"), (1, "y"), (1, "z"), (2, ""), rows[-1]])


def test_lines_made_to_collide_in_polynomials(spark):
    s, c = thue_morse()
    docs = spark.createDataFrame([(1, s), (2, s), (3, c)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in lines.line_digests(docs).collect()) == [(1, 0), (2, 0), (3, 0)]


def test_many_holders(spark):
    docs = spark.createDataFrame([(i, "one line that every document holds") for i in range(300)], "doc_id long, text string")
    for min_docs, gone in ((255, 299), (256, 299), (300, 299), (301, 0)):
        assert lines.lost_lines(docs, min_docs=min_docs)[1].count() == gone
