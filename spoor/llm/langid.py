"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three code points of the lower-cased text, runs of anything but letters being one
space. A feature's value is its share of the text's n-grams times its inverse document frequency, so a text's scores are
means over its n-grams and are found in one pass over it, whatever its length. Document frequencies count every document
that may be learned from. Weights are learned by follow-the-regularised-leader with absolute and squared penalties on a
bounded sample of about SAMPLE documents a language and TOTAL in all (all, if there are fewer); a part of the sample is kept back and sets
the temperature that calibrates the probabilities.

Defined results: a null text and one without a letter is `und` with score 0; null languages are not learned from; with no
languages everything is `und`, with one everything else is that one; ties go to the alphabetically first language; rows
may repeat; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm import text

SAMPLE, TOTAL, BITS = 1500, 8000, 18
ORDERS = (1, 2, 3)
EPOCHS, ALPHA, BETA, LASSO, RIDGE = 3, 0.5, 1.0, 0.02, 1.0
_U = np.uint64
UNKNOWN = "und"


class Letters:
    """Code points as lower-cased letters, anything else as a space; the table of letters is filled as they are met."""

    def __init__(self):
        self.fold = np.full(0x110000, 0xFFFFFFFF, np.uint32)          # what is not known yet
        self.fold[:128] = [ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self.fold[codes]
        if (new := out == 0xFFFFFFFF).any():
            for c in np.unique(codes[new]).tolist():
                low = chr(c).lower()
                self.fold[c] = (ord(low) if len(low) == 1 else c) if unicodedata.category(chr(c))[0] in "LM" else 32
            out = self.fold[codes]
        return out


def grams(texts: list[str], letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the number before each text (plus one), and which texts have a letter."""
    codes = letters(np.frombuffer("".join([f" {t} " for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32))
    size = np.array([len(t) + 2 for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    keep = np.ones(len(codes), bool)                                   # of a run of spaces the first
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (row[1:] != row[:-1])
    codes, row = codes[keep].astype(_U), row[keep]
    found, owner = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, _U)
        for j in range(n):
            h = h * _U(0x9E3779B97F4A7C15) + codes[j:len(codes) - n + 1 + j]
        h ^= h >> _U(29)
        h = (h * _U(0xBF58476D1CE4E5B9)) >> _U(64 - BITS)
        inside = row[n - 1:] == row[:len(codes) - n + 1]
        found.append(h[inside].astype(np.int32))
        owner.append(row[n - 1:][inside])
    h, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    has = np.bincount(row[codes != 32], minlength=len(texts)) > 0
    return h[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]), has


def _parts(values: list, size: int = text.PIECE // 4):
    """Runs of texts with about `size` characters."""
    start = 0
    while start < len(values):
        stop, total = start, 0
        while stop < len(values) and (stop == start or total + len(values[stop] or "") <= size):
            total += len(values[stop] or "")
            stop += 1
        yield start, stop, [t or "" for t in values[start:stop]]
        start = stop


def _frequencies(batches):
    """(feature, documents) of a partition: each document counts a feature once."""
    letters, count, n = Letters(), np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for _, _, texts in _parts(batch.column(0).to_pylist()):
            with np.errstate(over="ignore"):
                h, at, _ = grams(texts, letters)
            for a, b in zip(at[:-1], at[1:]):
                count[np.unique(h[a:b])] += 1
            n += len(texts)
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(count[some], n))], ["feature", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log(documents / documents with the feature) of the 2^BITS features: a bounded table, counted over all docs."""
    rows = docs.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    total = float(rows.loc[rows.feature < 0, "n"].sum())
    out = np.full(1 << BITS, np.log1p(total))
    seen = rows[rows.feature >= 0]
    out[seen.feature.to_numpy()] = np.log((1 + total) / (1 + seen.n.to_numpy())) + 0.1
    return out


def _counted(batches):
    """(lang, doc_id, features, counts) of the sampled documents."""
    letters = Letters()
    for batch in batches:
        for a, b, texts in _parts(batch.column(2).to_pylist()):
            with np.errstate(over="ignore"):
                h, at, _ = grams(texts, letters)
            each = [np.unique(h[x:y], return_counts=True) for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([f.astype(np.int32).tobytes() for f, _ in each], pa.binary()),
                 pa.array([c.astype(np.int32).tobytes() for _, c in each], pa.binary())], ["lang", "doc_id", "features", "counts"])


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of multinomial logistic regression, one document after the other. A weight is 0 until its
    accumulated gradient exceeds the absolute penalty."""
    z, n, bias = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes)), np.zeros(classes)

    def weights(f):
        zf = z[f]
        return -(zf - np.sign(zf) * LASSO) / ((BETA + np.sqrt(n[f])) / ALPHA + RIDGE) * (np.abs(zf) > LASSO)

    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            f, x = rows[i]
            w = weights(f)
            p = _softmax(x @ w + bias)
            p[y[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - step * w
            n[f] += g * g
            bias -= 0.01 * p
    return weights(slice(None)), bias


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of all documents of docs (doc_id, text, lang)."""
    docs = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    idf = inverse_frequencies(docs)
    share, sample = F.lit(0), min(sample, TOTAL / len(sizes))
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, sample / n) * (1 << 30))).otherwise(share)
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).mapInArrow(
        _counted, "lang string, doc_id long, features binary, counts binary").toPandas().sort_values(["doc_id", "lang"], kind="stable")
    rows, y = [], []
    for lang, raw, count in zip(chosen["lang"], chosen["features"], chosen["counts"]):
        f, c = np.frombuffer(raw, np.int32), np.frombuffer(count, np.int32)
        rows.append((f, c / max(1, c.sum()) * idf[f] * 10))
        y.append(languages.index(lang))
    y = np.array(y, np.int64)
    kept_back = np.arange(len(y)) % 10 == 9
    learn = np.flatnonzero(~kept_back)
    w, bias = follow_the_leader([rows[i] for i in learn], y[learn], len(languages))
    z = np.stack([rows[i][1] @ w[rows[i][0]] + bias for i in np.flatnonzero(kept_back)]) if kept_back.any() else np.zeros((0, len(languages)))
    temperature = min(np.geomspace(0.05, 20, 61), key=lambda t: _loss(z / t, y[kept_back]))
    return Model(languages, (w * idf[:, None] * 10).astype(np.float32), bias, float(temperature))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(_softmax(z)[np.arange(len(y)), y] + 1e-12).mean()) if len(y) else 0.0


def _predict(languages: list[str], bias: np.ndarray, temperature: float, rows: bytes, features: bytes):
    def predict(batches):
        table, letters = np.zeros((1 << BITS, len(languages)), np.float32), Letters()
        table[np.frombuffer(features, np.int32)] = np.frombuffer(rows, np.float32).reshape(-1, len(languages))
        for batch in batches:
            for a, b, texts in _parts(batch.column(1).to_pylist()):
                with np.errstate(over="ignore"):
                    h, at, has = grams(texts, letters)
                z = np.empty((len(texts), len(languages)))
                for c in range(len(languages)):
                    z[:, c] = np.add.reduceat(table[:, c][h], at[:-1], dtype=np.float64) / np.diff(at) + bias[c]
                p = _softmax(z / temperature)
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([languages[k] if ok else UNKNOWN for k, ok in zip(best, has)], pa.string()),
                     pa.array(np.where(has, p[np.arange(len(p)), best], 0.0))], ["doc_id", "lang_pred", "score"])
    return predict


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not model.languages:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    some = np.flatnonzero(model.table.any(axis=1)).astype(np.int32)      # the lasso leaves few; they travel with the tasks
    return rows.mapInArrow(_predict(model.languages, model.bias, model.temperature, np.ascontiguousarray(model.table[some]).tobytes(),
                                    some.tobytes()), "doc_id long, lang_pred string, score double")


def languages_of(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score; learned from the documents that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return predicted(docs, train(docs.filter(~held))).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")
