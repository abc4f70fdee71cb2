"""Repeated passages against brute force; hard rows."""

import hashlib
import random
from collections import Counter

import numpy as np

from spoor.llm import repeats
from tests.llm import brute
from tests.llm.test_text import thue_morse


def wanted(rows):
    return {i: (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
            for i, (n, kept) in brute.repeated_words(rows).items()}


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(repeats.repeat_digests(docs)) == wanted([(r.doc_id, r.text) for r in docs.collect()])


def test_hard_rows(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    passage, short = [word() for _ in range(60)], [word() for _ in range(34)]
    rows = [(1, None), (2, ""), (3, "a " * 34), (4, "a " * 35), (5, "a " * 90 + "b"), (6, "x y " * 60), (7, "B " * 36),
            (8, "p q r s t u v " * 20 + "end")]
    for i in range(10, 40):
        own = [f"u{i}_{j}" for j in range(rng.randrange(0, 50))]
        cut = rng.randrange(0, 25)
        rows.append((i, " ".join(own + passage[cut:cut + rng.randrange(30, 60)] + own[:20] + (short if i % 3 else []) + ["\n", "é"])))
    rows += [(50, rows[-1][1]), (51, rows[-1][1].replace(" ", "\t")), (52, " ".join(passage * 300))]
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, n_chars long, key string")
    assert got(repeats.repeat_digests(docs)) == wanted(rows)
    left = repeats.drop_repeats(docs)
    assert left.columns == docs.columns
    kept, before = brute.repeated_words(rows), dict(rows)
    for r in left.collect():
        n, words = kept[r.doc_id]
        if len(words) < n:
            assert (r.text, r.n_chars) == (" ".join(words), len(" ".join(words)))
        else:
            assert (r.text, r.n_chars) == (before[r.doc_id], 5)


def test_rows_without_id(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared_once, shared_copied, nameless_only = words(40), words(50), words(45)
    copy = f"{words(20)} {shared_copied} {words(20)}"
    lone = f"{words(30)} {nameless_only} {words(30)}"
    rows = [(None, f"{words(10)} {shared_once} {words(10)}"), (1, f"{words(15)} {shared_once} {words(5)}"),
            (None, copy), (2, copy), (3, copy), (4, f"{words(3)} {shared_copied} {words(4)}"),
            (None, lone), (None, f"{nameless_only} {words(12)}"), (None, words(60)), (5, words(60)), (None, None), (None, ""), (None, "a b"),
            (None, "z " * 80), (None, "z " * 80), (6, "y " + "z " * 50)]
    docs = spark.createDataFrame([(t, i, 5, "k", 1) for i, t in rows], "text string, doc_id long, n_chars int, one string, __kept2 int").coalesce(1)
    kept = brute.repeated_words([(k, t) for k, (_, t) in enumerate(rows)])
    digests = [(rows[k][0], n, n - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()) for k, (n, left) in kept.items()]
    assert Counter(map(tuple, repeats.repeat_digests(docs).collect())) == Counter(digests)
    wanted = [(" ".join(left), rows[k][0], len(" ".join(left)), "k", 1) if len(left) < n else (rows[k][1], rows[k][0], 5, "k", 1)
              for k, (n, left) in kept.items()]
    left = repeats.drop_repeats(docs)
    assert left.columns == docs.columns and Counter(map(tuple, left.collect())) == Counter(wanted)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeat_digests(docs).collect() == [] and repeats.drop_repeats(docs).collect() == []


def test_equal_substrings_share_keys_at_any_offset():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        for _ in range(20):
            common = rng.integers(0, 50, 100, dtype=np.uint64)
            a = np.concatenate([rng.integers(0, 50, rng.integers(0, 60), dtype=np.uint64), common])
            b = np.concatenate([common, rng.integers(0, 50, rng.integers(0, 60), dtype=np.uint64)])

            def of(x):
                key, first, last, _, _ = repeats.keys(x, np.array([0, len(x)]))
                return np.repeat(key, last - first + 1)
            assert (of(a)[len(a) - 100:] == of(b)[:66]).all()


def test_words_made_to_collide_in_polynomials(spark):
    s, c = thue_morse()
    around = [f"w{i}" for i in range(18)]
    rows = [(1, " ".join([*around, s, *around[::-1]])), (2, " ".join([*around, c, *around[::-1]])), (3, " ".join([*around, c, *around[::-1], "x"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.repeat_digests(docs)) == wanted(rows) and wanted(rows)[1][1] == 0 < wanted(rows)[2][1]


def test_windows_that_share_the_first_hash(spark, monkeypatch):
    plain = repeats._verify

    def poor(batches):
        import pyarrow as pa
        for b in plain(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v % 2 for v in b.column(0).to_pylist()], pa.int64()), *b.columns[1:]], b.schema.names)
    monkeypatch.setattr(repeats, "_verify", poor)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join([f"u{i}_{j}" for j in range(rng.randrange(20))] + passage[rng.randrange(20):][:rng.randrange(36, 60)] + [f"v{i}"] * 40)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.repeat_digests(docs)) == wanted(rows)
