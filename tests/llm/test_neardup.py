"""Near-duplicates against brute force; hard rows."""

import random

import pytest

from spoor.llm import graph, neardup
from tests.llm import brute
from tests.llm.test_text import thue_morse


def rows_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows_of(neardup.near_duplicates(docs)) == brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_and_hard_rows(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "é " * 30)]
    base = [rng.choice(words) for _ in range(300)]
    for i in range(100, 160):                       # a drifting chain: neighbours are near, its ends are not
        base = list(base)
        base[rng.randrange(300)] = rng.choice(words)
        base[rng.randrange(300)] = rng.choice(words)
        rows.append((i, " ".join(base)))
    rows += [(200 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(50)]
    rows.append((300, " ".join(words * 500)))       # a very long text
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, cid string")
    assert rows_of(neardup.near_duplicates(docs)) == brute.near_duplicates(rows)
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in brute.near_duplicates(rows).items() if i == c}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).collect() == [] and neardup.drop_near_duplicates(docs).collect() == []


@pytest.mark.parametrize("pairs,wanted", [
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([(9, 3), (3, 7), (5, 6), (6, 6)], {3: 3, 7: 3, 9: 3, 5: 5, 6: 5}),
    ([], {})])
def test_components(spark, pairs, wanted):
    links = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.component for r in graph.components(links).collect()} == wanted


def test_words_made_to_collide_in_polynomials(spark):
    s, c = thue_morse()
    docs = spark.createDataFrame([(1, s), (2, s), (3, c)], "doc_id long, text string")
    assert rows_of(neardup.near_duplicates(docs)) == {1: (1, 1), 2: (1, 1), 3: (1, 3)}


def test_missing_and_repeated_ids(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(n))
    one, two, three, lone = words(60), words(80), words(70), words(50)
    near = two.rsplit(" ", 3)[0]
    rows = [(1, one), (2, two), (5, one), (5, three), (6, near), (6, words(40)), (7, three), (7, three),
            (None, one), (None, near), (None, lone), (None, lone), (None, ""), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, one int").repartition(3)
    found = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect() if r.doc_id is not None)
    assert found == [(1, 1, True), (2, 2, True), (5, 1, False), (5, 5, True), (6, 2, False), (6, 6, True), (7, 5, False), (7, 5, False),
                     (8, 8, True), (8, 8, True)]
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    wanted = [(1, one), (2, two), (5, three), rows[5], (None, lone), (None, ""), (None, None), (8, ""), (8, "")]
    assert sorted(map(repr, [(r.doc_id, r.text) for r in left.collect()])) == sorted(map(repr, wanted))
