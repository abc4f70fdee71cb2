"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees over statistics of a text are taken apart into conjunctive rules (every path from the root is one),
lasso logistic regression keeps a few of them with weights, and these become one Spark column expression.

Learning uses a bounded sample: at most about SAMPLE labelled documents, chosen by a hash of doc_id (all, if there are
fewer). Statistics cover whole texts; labels, language, source and doc_id are no inputs.

Defined results: a null text counts as empty and is scored like any text; labels that are null or of unknown documents
are not used, of several labels of one doc_id the highest; without labels every score is 0.5; with labels of one kind it
is near that label; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm import text

SAMPLE = 30_000
TREES, DEPTH, RATE, BINS, LEAF = 40, 3, 0.2, 32, 20
PENALTY = 2e-4

STATISTICS = ["log_chars", "log_words", "word_length", "long_word", "upper", "digits", "marks", "exclaims", "bars", "high_bytes",
              "white", "line_length", "line_repeats", "word_variety", "top_word", "same_next", "capitals", "no_letter", "short_words",
              "run_repeats", "byte_variety", "brackets", "ends", "odd_bytes", "five_repeats"]
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CLASSES = {"upper": range(65, 91), "digits": range(48, 58), "exclaims": b"!?", "bars": b"|\\/_#*=~^", "high_bytes": range(128, 256),
            "white": (9, 10, 11, 12, 13, 32), "brackets": b"{}[]<>()", "ends": b".,;:",
            "marks": [c for c in range(33, 127) if not chr(c).isalnum()], "odd_bytes": [*range(9), *range(14, 32), 127, 0xEF, 0xBF]}
_U = np.uint64


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _variety(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the most frequent one's count, by row."""
    out = np.zeros((2, len(bounds) - 1))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            s = np.sort(h[a:b])
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            out[:, i] = len(at) - 1, np.diff(at).max()
    return out[0], out[1]


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: text.SpanHasher) -> np.ndarray:
    """One row of numbers per text, in the order of STATISTICS; all zero for an empty text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, bounds = text.words(data, offsets)
    n_words, lengths = np.diff(bounds), ends - starts
    per_word = np.maximum(n_words, 1)
    row = np.repeat(np.arange(n), n_words)
    h = hasher(data, starts, ends)
    x = dict.fromkeys(STATISTICS, np.zeros(n))
    x["log_chars"], x["log_words"] = np.log1p(text.characters(data, offsets[:-1], offsets[1:])), np.log1p(n_words)
    for name, members in _CLASSES.items():
        is_in = np.zeros(256, bool)
        is_in[list(members)] = True
        x[name] = _per_row(is_in[data], offsets) / size
    x["word_length"] = _per_row(lengths, bounds) / per_word
    x["short_words"] = _per_row(lengths <= 3, bounds) / per_word
    longest = np.zeros(n)
    np.maximum.at(longest, row, lengths)
    x["long_word"] = np.log1p(longest)
    if len(starts):
        head = data[starts]
        x["capitals"] = _per_row((head >= 65) & (head <= 90), bounds) / per_word
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        x["no_letter"] = _per_row(letters[ends] == letters[starts], bounds) / per_word
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        x["same_next"] = _per_row(same, bounds) / per_word
        distinct, top = _variety(h, bounds)
        x["word_variety"], x["top_word"] = distinct / per_word, top / per_word
        x["run_repeats"] = distinct / np.sqrt(per_word)
        with np.errstate(over="ignore"):
            five = np.concatenate([text.windows(h, 5), np.zeros(min(4, len(h)), _U)])
        whole = np.maximum(bounds[1:] - 4, bounds[:-1])
        ok = np.arange(len(h)) < whole[row]
        some = np.concatenate([[0], np.cumsum(_per_row(ok, bounds))])
        distinct, _ = _variety(five[:len(h)][ok], some)
        x["five_repeats"] = 1 - distinct / np.maximum(np.diff(some), 1)
    ls, le, lb = text.lines(data, offsets)
    distinct, _ = _variety(hasher(data, ls, le), lb)
    x["line_length"], x["line_repeats"] = np.log1p(size / np.maximum(np.diff(lb), 1)), 1 - distinct / np.maximum(np.diff(lb), 1)
    x["byte_variety"] = np.array([np.count_nonzero(np.bincount(data[a:b], minlength=256)) for a, b in zip(offsets[:-1], offsets[1:])], float)
    return np.where(np.diff(offsets)[:, None] > 0, np.stack([x[k] for k in STATISTICS], axis=1), 0.0)


_PREFIX = "__stat_"


def with_statistics(df: DataFrame) -> DataFrame:
    """df (with a column text) and its statistics as columns."""
    at = df.columns.index("text")
    schema = T.StructType(df.schema.fields + [T.StructField(_PREFIX + k, T.DoubleType()) for k in STATISTICS])

    def add(batches):
        hasher = text.SpanHasher(4, lower=True)
        for batch in batches:
            for a, b, data, offsets in text.pieces(batch.column(at)):
                with np.errstate(over="ignore"):
                    found = statistics(data, offsets, hasher)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *map(pa.array, found.T)], schema.names)
    return df.mapInArrow(add, schema)


# ---- learning (bounded sample, on the driver) ----------------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]        # conditions (statistic, above, threshold)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, at in rule:
        out &= (x[:, k] > at) == above
    return out


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees; each node splits where the gain in the logistic loss is largest."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)]       # bin <= i: x <= cuts[i]
    margin, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, w = y - p, p * (1 - p)
        nodes = [((), np.arange(len(y)))]
        for _ in range(DEPTH):
            below = []
            for rule, rows in nodes:
                best = (1e-6, None)
                total_g, total_w = g[rows].sum(), w[rows].sum()
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[k][rows]
                    left_n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    left_g = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                    left_w = np.cumsum(np.bincount(b, w[rows], len(c) + 1))[:-1]
                    gain = left_g**2 / (left_w + 1) + (total_g - left_g)**2 / (total_w - left_w + 1) - total_g**2 / (total_w + 1)
                    gain[(left_n < LEAF) | (len(rows) - left_n < LEAF)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), (k, int(gain.argmax())))
                if best[1] is None:
                    margin[rows] += RATE * total_g / (total_w + 1)
                    continue
                k, i = best[1]
                above = binned[k][rows] > i
                below += [(rule + ((k, False, float(cuts[k][i])),), rows[~above]), (rule + ((k, True, float(cuts[k][i])),), rows[above])]
            rules.update(dict.fromkeys(r for r, _ in below))
            nodes = below
        for _, rows in nodes:
            margin[rows] += RATE * g[rows].sum() / (w[rows].sum() + 1)
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression with an absolute penalty, by accelerated proximal gradient steps."""
    n, rate = len(y), 4.0 / (1 + np.linalg.norm(z, 2)**2 / len(y))
    w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - rate * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b, nt = c - rate * error.mean(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new, new_b, nt
    return w, b


class Model:
    """Weighted rules; `score` is the column expression over the statistics."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def score(self) -> Column:
        margin = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for k, above, at in rule:
                value = F.col(_PREFIX + STATISTICS[k])
                holds = holds & ((value > at) if above else (value <= at))
            margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model([], [], 0.0)
    if y.min() == y.max():
        return Model([], [], 7.0 if y[0] else -7.0)
    rules = tree_rules(x, y)
    z = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    scale = np.maximum(z.std(axis=0), 0.05)
    z = (z - z.mean(axis=0)) / scale if len(rules) else z
    mean = np.stack([_holds(r, x) for r in rules], axis=1).mean(axis=0) if rules else np.zeros(0)
    w, b = lasso(z, y, PENALTY)
    w = w / scale
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Model([rules[i] for i in kept], [float(w[i]) for i in kept], float(b - (w * mean).sum()))


def sample_of(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of doc_id; all, if there are fewer."""
    n = df.count()
    return df if n <= rows else df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """The model of labels (doc_id, quality); only the sampled documents' texts are looked at."""
    marked = sample_of(labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                       .agg((F.max("quality") >= 1).cast("int").alias("quality")), rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(marked), "doc_id")                      # bounded by `rows`
    found = with_statistics(chosen).drop("text").toPandas().sort_values("doc_id", kind="stable")
    return fit(found[[_PREFIX + k for k in STATISTICS]].to_numpy(float), found["quality"].to_numpy(float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column score."""
    return with_statistics(docs).withColumn("score", model.score()).drop(*[_PREFIX + k for k in STATISTICS])


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from; the others are held out."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    model = train(docs, learnable(labels))
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
                       "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, whose score is 0.5 or more; learned from all labels that may be learned from."""
    model = train(docs, learnable(labels))
    kept = docs.withColumn("text", F.col("text").cast("string"))
    rows = with_statistics(kept).filter(model.score() >= 0.5)
    return rows.select(docs.columns)
