"""Quality and language classifiers: held-out accuracy, column expressions against plain evaluation, hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.llm import langid, quality, text
from spoor.llm.registry import table

SF = "/root/testdata/sf0.1"


def test_quality_held_out(spark):
    rows = quality.predictions(table(spark, SF, "documents"), table(spark, SF, "labels"))
    held = rows.filter("held_out").join(table(spark, SF, "labels"), "doc_id").toPandas()
    assert len(held) > 1000 and (held.predicted == held.quality).mean() > 0.99
    assert held.score.between(0, 1).all() and ((held.score >= 0.5) == (held.predicted == 1)).all()


def test_quality_rules(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.2) | (x[:, 5] > 1.5)).astype(float)
    model = quality.fit(x, y)
    columns = [quality._PREFIX + s for s in quality.STATISTICS]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:200]], columns)
    got = np.array([r[0] for r in df.select(model.score()).collect()])
    margin = model.intercept + sum(w * quality._holds(r, x[:200]) for r, w in zip(model.rules, model.weights))
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))
    assert ((got >= 0.5) == y[:200]).mean() > 0.95 and len(model.rules) < 200


def test_quality_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "a b", 7), (4, "x" * 200_000, 8), (4, "x" * 200_000, 8), (5, "\n \t", 9)],
                                 "doc_id long, text string, quality int")
    none = spark.createDataFrame([(9, None), (None, 1)], "doc_id long, quality int")
    rows = quality.predictions(docs, none).collect()
    assert len(rows) == 6 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 6
    assert quality.predictions(docs.filter("doc_id = 77"), none).collect() == []
    one = spark.createDataFrame([(i, 0) for i in (1, 2, 4, 5)], "doc_id long, quality int")
    assert quality.keep_good(docs, one).count() == 0


def test_statistics_do_not_depend_on_the_piece():
    rows = ["One two, two.\nThree!", "", "ÉÉ 12 | x", "a a a a a a b", "x"]
    data = "".join(rows).encode()
    offsets = np.cumsum([0] + [len(r.encode()) for r in rows])
    with np.errstate(over="ignore"):
        every = quality.statistics(np.frombuffer(data, np.uint8), offsets, text.SpanHasher(4, lower=True))
        for i, r in enumerate(rows):
            alone = quality.statistics(np.frombuffer(r.encode(), np.uint8), np.array([0, len(r.encode())]), text.SpanHasher(4, lower=True))
            assert np.array_equal(every[i], alone[0])


@pytest.mark.parametrize("sf,least", [("/root/testdata/sf0.01", 0.99), (SF, 0.995)])
def test_language_held_out(spark, sf, least):
    docs = table(spark, sf, "documents")
    rows = langid.languages_of(docs).withColumnRenamed("doc_id", "id").join(docs, F.col("id") == F.col("doc_id")).toPandas()
    held = rows[rows.held_out]
    right = held.lang_pred == held.lang
    assert len(rows) == docs.count() and right.mean() > least
    assert abs(held.score.mean() - right.mean()) < 0.02                # calibrated


def test_language_hard_rows(spark):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(20)] + [(i, "der hund und die katze " * 5, "de") for i in range(20, 40)]
    hard = [(100, None, None), (101, "", "en"), (102, "12 34 !!", None), (103, "THE DOG", None), (104, "die katze " * 20_000, None), (104, "Katze und", "de")]
    schema = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame([(*r, "s") for r in rows + hard], schema)
    got = {(r.doc_id, r.lang_pred) for r in langid.languages_of(docs).collect() if r.doc_id >= 100}
    assert got == {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (104, "de")}
    nothing = langid.languages_of(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)} and len(nothing) == 46
    assert {r.lang_pred for r in langid.languages_of(docs.filter("lang = 'de'")).collect()} == {"de"}
    assert langid.languages_of(docs.filter("doc_id = -1")).collect() == []
