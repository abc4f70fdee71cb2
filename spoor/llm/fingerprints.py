"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. On each level runs of an equal name become one name, then deterministic coin tossing
labels each name by the lowest bit in which it differs from its left neighbour and that bit's value; labels of labels have
few values after four rounds, so local minima cut the sequence into short phrases, whose names are hashes of what they hold.
A cut depends on a handful of names around it: equal substrings are parsed alike but for their ends, at any offset.

The fingerprint is a sketch of the phrase names of several levels: the least hashes of each of its bins, as hexadecimal
text. The likeness of two fingerprints is the share of bins that agree, an estimate of the phrases two texts share.

Defined results: a null text counts as empty; equal texts have equal fingerprints, whatever their ids; a text without any
phrase (the empty one) has the empty fingerprint, like another empty one (1) and unlike any other (0); rows that share a
doc_id follow each other in the order of their texts; rows without doc_id have no next document, and are no one's next
(they are edited with nothing); the only document is its own next one; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm import text

LEVELS = (2, 3)           # whose phrase names are sketched; of a short text those below too
BINS = 64
DIGITS = 8                # hexadecimal digits a bin
_U = np.uint64


def _neighbour(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Every element's left neighbour; the first of a text gets one that differs from it."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = ~x[first]
    return out


def _labels(x: np.ndarray, first: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Deterministic coin tossing on a sequence without equal neighbours: small labels, again without equal neighbours."""
    for _ in range(rounds):
        differ = x ^ _neighbour(x, first)
        low = differ & (~differ + _U(1))                               # the lowest bit in which they differ
        place = np.frexp(low.astype(np.float64))[1].astype(_U) - _U(1)
        x = place * _U(2) + ((x & low) != 0).astype(_U)
    return x


def level_up(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level and the bounds of each text in them."""
    if not len(x):
        return x, bounds
    start = np.zeros(len(x) + 1, bool)
    start[bounds] = True
    new = start[:-1].copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)                                           # runs
    count = np.diff(np.append(at, len(x)))
    name = np.where(count > 1, text.mix(x[at] + count.astype(_U) * _U(0x9E3779B97F4A7C15)), x[at])
    first = start[at]
    label = _labels(name, np.flatnonzero(first))
    lower = np.ones(len(at), bool)                                     # cut where a label is a local minimum
    lower[1:] = label[1:] < label[:-1]
    lower[:-1] &= (label[:-1] < label[1:]) | first[1:]
    cut = np.flatnonzero(lower | first)
    total = np.add.reduceat(text.mix(name) * _powers(at, cut), cut)
    return text.mix(total + np.diff(np.append(cut, len(at))).astype(_U)), np.searchsorted(at[cut], bounds)


def _powers(at: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """An odd factor for each place within a phrase."""
    place = np.arange(len(at)) - np.repeat(cut, np.diff(np.append(cut, len(at))))
    return text.mix(place.astype(_U) + _U(17)) | _U(1)


def sketches(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BINS minima (32 bits) for every text; all ones in a text without names."""
    n = len(bounds) - 1
    out = np.full((n, BINS), 0xFFFFFFFF, _U)
    name, here = text.mix(codes.astype(_U) + _U(1)), bounds
    for level in range(max(LEVELS) + 1):
        few = np.diff(here) < 4                                        # too short for the levels above: all it has
        use = np.ones(n, bool) if level in LEVELS else few
        if level:
            use &= np.diff(here) > 0
        if use.any():
            row = np.repeat(np.arange(n), np.diff(here))
            sel = use[row]
            h = text.mix(name[sel] + _U(level * 7919))
            key = row[sel] * BINS + (h >> _U(32)).astype(np.int64) % BINS
            np.minimum.at(out.reshape(-1), key, h & _U(0xFFFFFFFF))
        name, here = level_up(name, here)
    return _filled(out)


def _filled(out: np.ndarray) -> np.ndarray:
    """Empty bins borrow from the nearest filled bin to their right, changed by the distance."""
    empty = out == 0xFFFFFFFF
    if not empty.any():
        return out
    some = ~empty.all(axis=1)
    for step in range(1, BINS):
        if not (empty[some]).any():
            break
        lent, free = np.roll(out, -step, axis=1), np.roll(out == 0xFFFFFFFF, -step, axis=1)
        take = empty & ~free & some[:, None]
        out = np.where(take, text.mix(lent + _U(step << 40)) & _U(0xFFFFFFFE), out) if take.any() else out
        empty &= ~take
    return out


def _hex(row: np.ndarray) -> str:
    return "" if (row == 0xFFFFFFFF).all() else row.astype(">u4").tobytes().hex()


def fingerprints(texts: list[str]) -> list[str]:
    """One fingerprint a text, a bounded number of characters at a time."""
    out, start = [], 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= text.PIECE // 2):
            size += len(texts[stop])
            stop += 1
        part = texts[start:stop]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        with np.errstate(over="ignore"):
            out += [_hex(r) for r in sketches(codes, np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64))]
        start = stop
    return out


def likeness(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4") for s in (a, b))
    return float((x == y).mean())


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs and the column fingerprint of their text."""
    at, names = docs.columns.index("text"), [*docs.columns, "fingerprint"]

    def add(batches):
        for batch in batches:
            found = fingerprints([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names)
    return docs.mapInArrow(add, docs.schema.add("fingerprint", "string"))


# ---- each document beside the next one in descending order of ids ----------------------------------------------------

ROWS, RANGES = 2000, 1000     # documents of one range of ids, and ranges at most: a range is streamed, whatever its size


def _ranges(docs: DataFrame) -> tuple[list[int], list[tuple]]:
    """Bounds that cut the ids into ranges, and for every range that has rows the id that follows its last one: facts of
    one row a range."""
    cuts = min(RANGES, max(1, -(-docs.count() // ROWS)))
    bounds = docs.stat.approxQuantile("doc_id", [i / cuts for i in range(1, cuts)], 0.2 / cuts) if cuts > 1 else []
    bounds = sorted({int(b) for b in bounds})
    heads = docs.groupBy(_range(bounds)(F.col("doc_id")).alias("range")).agg(F.max("doc_id").alias("top")).collect()
    order = sorted(((r["range"], r["top"]) for r in heads), reverse=True)
    return bounds, [(a[0], b[1]) for a, b in zip(order, order[1:] + order[:1])]


def _range(bounds: list[int]):
    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(np.int64)).astype(np.int32))
    return number


def beside_next(docs: DataFrame) -> DataFrame:
    """(range, extra, doc_id, text) such that within a range, in descending order, each row's next one follows it; the
    rows marked extra are only there to be next. A text is moved once, and once more where it heads a range."""
    bounds, follows = _ranges(docs)
    tops = docs.sparkSession.createDataFrame([(r, t) for r, t in follows], "range int, top long")
    rows = docs.select(_range(bounds)(F.col("doc_id")).alias("range"), F.lit(False).alias("extra"), "doc_id", "text")
    heads = docs.filter(F.col("doc_id").isin([t for _, t in follows])).join(F.broadcast(tops), F.col("doc_id") == F.col("top")).select(
        "range", F.lit(True).alias("extra"), "doc_id", "text")           # at most RANGES ids
    return rows.unionAll(heads).repartition(max(1, len(follows)), "range").sortWithinPartitions("range", "extra", F.desc("doc_id"), "text")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches):
    """Rows (range, extra, doc_id, text) as beside_next orders them: each document against its edited text and the next one."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(i).to_pylist() for i in range(4)))
        yield _compared(held[:-1], held[1:])
        held = held[-1:]
    yield _compared(held, [])


def _compared(rows: list[tuple], nexts: list[tuple]) -> pa.RecordBatch:
    out: list[tuple] = []
    for a in range(0, len(rows), 200):
        part = rows[a:a + 200]
        texts = [t or "" for *_, t in part]
        after = [n or "" for *_, n in nexts[a:a + 200]]
        after += [""] * (len(texts) - len(after))
        changed = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, after)]
        own, edited = fingerprints(texts + after[-1:]), fingerprints(changed)
        out += [(r[2], len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), f, e, likeness(f, e), likeness(f, x))
                for r, t, c, f, e, x in zip(part, texts, changed, own, edited, own[1:]) if not r[1]]
    columns = list(zip(*out)) if out else [[]] * 7
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _alone(batches):
    for batch in batches:
        for i, t in zip(*(batch.column(c).to_pylist() for c in range(2))):
            yield _compared([(0, False, i, t)], [])


def fingerprint_digests(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like they and the next document's are."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = beside_next(docs.filter("doc_id IS NOT NULL")).mapInArrow(_edited, _RESULT)
    return rows.unionAll(docs.filter("doc_id IS NULL").mapInArrow(_alone, _RESULT))
