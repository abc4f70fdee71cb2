"""Substring dedup by locally consistent recompression: words that a window of 35 words covers which also starts anywhere
else are removed.

Words are named by hashes. One round names runs of an equal name, the following rounds name pairs: a round deals all
names into left and right ones by a bit of a hash, and every left name followed by a right one becomes one new name. The
rounds run inside each text. Names are hashes of what they stand for, so all executors give equal substrings equal names
without a dictionary to agree on, and a symbol depends on a few neighbours only: each carries the range of words its parse
depends on. A window contains the symbols whose ranges lie inside it, equal windows contain the same ones, and the least of
them stands for the window (a window inside a long run contains none and stands for itself). So

1. every text becomes a few dozen keys per thousand words, each with the windows it stands for;
2. Spark counts the keys of all texts; the windows of a key that occurs once occur once;
3. the remaining windows are verified: their own hashes, 96 bits of two constructions, are counted, and those that occur
   twice are repeats. (Of 10^11 windows two different ones share all 96 bits with a probability below 10^-6.)

Texts with equal words are copies: one stands for all of them in these counts, and all lose everything. Windows are
judged on the input, not on what is left.

Defined results: a null or empty text has no words; fewer than 35 words lose nothing; rows may share a doc_id (each is
answered by its own text in the digests; `drop_repeats` asks for one text per doc_id); rows without doc_id count and lose
words like all others (their texts are looked up by the identity of their words); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm import shared, text

SIZE = 35
ROUNDS = 5
IDENTITY = ["one", "two", "n_words"]
_U = np.uint64


def symbols(h: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after all rounds and the range [low, high) of words each depends on, in order.
    A symbol that depends on an end of its row has a range that reaches over it."""
    begin, end = bounds[:-1], bounds[1:]
    row = np.repeat(np.arange(len(begin)), end - begin)
    n = len(h)
    # runs
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    count = last - first + 1
    name = np.where(count > 1, text.mix(h[first] * _U(3) + count.astype(_U)), h[first])
    row = row[first]
    low = np.maximum(first - 1, begin[row] - 1)
    high = np.minimum(last + 2, end[row] + 1)
    # pairs
    for t in range(1, rounds + 1):
        n = len(name)
        right = (text.mix(name + _U(t * 40503 + 1)) & _U(1)).astype(bool)
        beside = np.zeros(n, bool)
        beside[:-1] = row[1:] == row[:-1]
        joins = beside.copy()
        joins[:-1] &= ~right[:-1] & right[1:]
        at = np.flatnonzero(~np.concatenate([[False], joins[:-1]]))
        pair, is_right, here = joins[at], right[at], row[at]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 1, n - 1)
        has_before = (at > 0) & (row[before] == here)
        name = np.where(pair, text.mix(name[at] * _U(0x9E3779B97F4A7C15) + text.mix(name[after] + _U(t))), name[at])
        low = np.where(pair | ~is_right, low[at], np.where(has_before, low[before], begin[here] - 1))
        high = np.where(pair, high[after], np.where(is_right, high[at], np.where(beside[at], high[after], end[here] + 1)))
        row = here
    return name, low, high


def keys(h: np.ndarray, bounds: np.ndarray, size: int = SIZE, rounds: int = ROUNDS):
    """(key, first window, last window, weight) of the keys that stand for all windows, with the number of keys before
    each row. Weight: the places where the key occurs."""
    n_windows = np.maximum(bounds[1:] - bounds[:-1] - size + 1, 0)
    total = int(n_windows.sum())
    if not total:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, _U), empty, empty, empty, np.zeros(len(bounds), np.int64)
    offset = np.cumsum(n_windows) - n_windows
    where = np.arange(total) + np.repeat(bounds[:-1] - offset, n_windows)      # the first word of every window
    name, low, high = symbols(h, bounds, rounds)
    left = np.searchsorted(low, where)
    right = np.searchsorted(high, where + size, "right") - 1
    inside = np.flatnonzero(right >= left)
    chosen = np.full(total, -1, np.int64)
    if len(inside):
        order = np.argsort(text.mix(name + _U(5)), kind="stable")
        rank = np.empty(len(name), np.int64)
        rank[order] = np.arange(len(name))
        a, b = left[inside], right[inside]
        step = np.frexp((b - a + 1).astype(float))[1] - 1                      # the largest power of two that fits
        least, best = rank, np.empty(len(inside), np.int64)
        for k in range(int(step.max()) + 1):
            if k:
                least = least.copy()
                least[:len(rank) - (1 << (k - 1))] = np.minimum(least[:len(rank) - (1 << (k - 1))], least[1 << (k - 1):])
            now = step == k
            best[now] = np.minimum(least[a[now]], least[b[now] - (1 << k) + 1])
        chosen[inside] = order[best]
    key = np.empty(total, _U)
    key[inside] = name[chosen[inside]]
    alone = np.flatnonzero(chosen < 0)
    if len(alone):
        every = text.windows(h, size)
        key[alone] = every[where[alone]]
    owner = np.repeat(np.arange(len(n_windows)), n_windows)
    change = np.ones(total, bool)
    change[1:] = (owner[1:] != owner[:-1]) | (chosen[1:] != chosen[:-1]) | ((chosen[1:] < 0) & (key[1:] != key[:-1]))
    first = np.flatnonzero(change)
    last = np.append(first[1:], total) - 1
    weight = np.where(chosen[first] < 0, last - first + 1, 1)
    base = offset[owner[first]]
    return key[first], first - base, last - base, weight, np.searchsorted(owner[first], np.arange(len(bounds)))


def _texts(column) -> Iterator[tuple]:
    """Pieces of a column: first row, end row, bytes, word starts and ends, bounds, word hashes of two constructions, identity
    of each row."""
    hasher = text.SpanHasher(8)
    for a, b, data, offsets in text.pieces(column):
        starts, ends, bounds = text.words(data, offsets)
        with np.errstate(over="ignore"):
            h, g = hasher.both(data, starts, ends)
            place = text.mix(np.arange(len(h), dtype=_U) - np.repeat(bounds[:-1], np.diff(bounds)).astype(_U) + _U(1))
            total = np.concatenate([np.zeros(1, _U), np.cumsum(text.mix(h + place))])
            again = np.concatenate([np.zeros(1, _U), np.cumsum(text.mix(g ^ (place * _U(5))))])
            one, two = (x[bounds[1:]] - x[bounds[:-1]] for x in (total, again))
        yield a, b, data, starts, ends, bounds, h, g, one.view(np.int64), two.view(np.int64)


_PROFILE = "doc_id long, n_words long, one long, two long, sha string, keys binary, spans binary, weights binary"


def _profile(batches):
    for batch in batches:
        for a, b, data, starts, ends, bounds, h, _, one, two in _texts(batch.column(1)):
            with np.errstate(over="ignore"):
                key, first, last, weight, at = keys(h, bounds)
            whole, edge = text.all_joined(data, starts, ends, bounds)
            span, weight = first << 32 | last, np.minimum(weight, 2).astype(np.uint8)
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds).astype(np.int64)), pa.array(one), pa.array(two),
                 pa.array([hashlib.sha256(whole[i:j]).hexdigest() for i, j in zip(edge[:-1], edge[1:])], pa.string()),
                 cut(key), cut(span), cut(weight)], ["doc_id", "n_words", "one", "two", "sha", "keys", "spans", "weights"])


def _unpack(batches):
    for batch in batches:
        packed = [batch.column(i).to_pylist() for i in (1, 2, 3)]
        count = np.array([len(x) for x in packed[2]], np.int64)
        key, span, weight = (np.frombuffer(b"".join(x), t) for x, t in zip(packed, (np.int64, np.int64, np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(batch.column(0).to_numpy(), count)), pa.array(span),
                                          pa.array(weight.astype(np.int32))], ["key", "tid", "span", "weight"])


def _verify(batches):
    """(two hashes, tid, start) of the windows in question; columns: tid, one, spans (packed), text."""
    for batch in batches:
        tid, wanted, spans = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        for a, b, _, _, _, bounds, h, g, one, _ in _texts(batch.column(3)):
            with np.errstate(over="ignore"):
                every, again = text.windows(h, SIZE).view(np.int64), text.windows(g, SIZE, seed=13).astype(np.uint32).view(np.int32)
            out = []
            for i in range(b - a):
                if one[i] == wanted[a + i]:
                    start = _starts(spans[a + i].values.to_numpy())
                    out.append((every[bounds[i] + start], again[bounds[i] + start], np.full(len(start), tid[a + i]), start.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["h", "g", "tid", "start"])


def _starts(spans: np.ndarray) -> np.ndarray:
    first, last = spans >> 32, spans & 0xFFFFFFFF
    count = last - first + 1
    return np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _cut(batches):
    """What is left of the texts; columns: tid, doc_id, one, starts of repeated windows, text."""
    for batch in batches:
        wanted, starts_of = batch.column(2).to_numpy(), batch.column(3)
        for a, b, data, starts, ends, bounds, _, _, one, two in _texts(batch.column(4)):
            keep, mine = np.ones(len(starts), bool), one == wanted[a:b]
            for i in np.flatnonzero(mine).tolist():
                cover = np.zeros(bounds[i + 1] - bounds[i] + 1, np.int64)
                at = starts_of[a + i].values.to_numpy()
                np.add.at(cover, at, 1)
                np.add.at(cover, at + SIZE, -1)
                keep[bounds[i]:bounds[i + 1]] = np.cumsum(cover)[:-1] == 0
            kept = text.joined(data, starts, ends, keep, bounds)
            gone = np.add.reduceat(np.append(~keep, False).astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0)
            ok = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).take(pa.array(ok)), batch.column(1).slice(a, b - a).take(pa.array(ok)),
                 pa.array(gone[ok]), pa.array([kept[i] for i in ok.tolist()], pa.binary()), pa.array(one[ok]), pa.array(two[ok]),
                 pa.array(np.diff(bounds)[ok].astype(np.int64))], ["tid", "doc_id", "n_removed", "kept", *IDENTITY])


def _identified(batches):
    """The rows without their last column, the text, and its identity in three columns more."""
    for batch in batches:
        for a, b, _, _, _, bounds, _, _, one, two in _texts(batch.column(batch.num_columns - 1)):
            own = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(one), pa.array(two), pa.array(np.diff(bounds).astype(np.int64))],
                                             [*batch.schema.names[:-1], *(f"__{c}" for c in IDENTITY)])


def _nameless(docs: DataFrame) -> DataFrame:
    """The rows without doc_id, all columns, and the identity of their words as __one, __two, __n_words."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"__{c}", T.LongType()) for c in IDENTITY)])
    return docs.filter("doc_id IS NULL").withColumn("__text", F.col("text").cast("string")).mapInArrow(_identified, schema)


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (with doc_id and identity) and the texts of that id; those without doc_id and one text of that identity."""
    named = shared.only(docs, rows.select("doc_id").distinct(), "doc_id").join(rows, "doc_id")
    nameless = rows.filter("doc_id IS NULL")
    if nameless.isEmpty():
        return named
    found = _nameless(docs).select("text", *(F.col(f"__{c}").alias(c) for c in IDENTITY))
    found = shared.only(found, nameless.select("one").distinct(), "one").dropDuplicates(IDENTITY)
    return named.unionByName(found.join(nameless, IDENTITY))


def shortened(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles with their number of copies, what is left of the texts that lose words and have no copy)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = docs.mapInArrow(_profile, _PROFILE)
    profile = shared.written(profile.withColumn("tid", F.monotonically_increasing_id()), "repeat-profiles")
    same = IDENTITY
    copied = shared.written(profile.filter(f"n_words >= {SIZE}").groupBy(same).agg(F.count("*").alias("copies"), F.min("tid").alias("first"))
                            .filter("copies > 1"), "copies")
    spare = profile.select("tid", *same).join(copied, same).filter("tid <> first").select("tid")
    alone = profile.select("tid", "keys", "spans", "weights").filter("length(keys) > 0").join(
        F.broadcast(spare) if spare.limit(shared.BROADCAST_IDS + 1).count() <= shared.BROADCAST_IDS else spare, "tid", "left_anti")

    places = alone.select("tid", "keys", "spans", "weights").mapInArrow(_unpack, "key long, tid long, span long, weight int")
    often = places.groupBy("key").agg(F.sum("weight").alias("n")).filter("n > 1").select("key")
    spans = places.drop("weight").join(often, "key").groupBy("tid").agg(F.collect_list("span").alias("spans"))
    asked = shared.written(spans.join(profile.select("tid", "doc_id", *same), "tid"), "asked-windows")

    windows = _with_text(docs, asked).select("tid", "one", "spans", "text").mapInArrow(
        _verify, "h long, g int, tid long, start int")
    counted = windows.groupBy("h").agg(F.count("*").alias("n"), F.min("g").alias("low"), F.max("g").alias("high")).filter("n > 1")
    counted = shared.written(counted, "window-counts")
    twice = windows.drop("g").join(counted.filter("low = high").select("h"), "h").select("tid", "start")
    mixed = counted.filter("low <> high").select("h")
    if not mixed.isEmpty():                                 # windows that share the first hash only
        told = shared.written(shared.only(windows, mixed, "h"), "mixed-windows")
        again = told.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1").select("h", "g")
        twice = twice.unionByName(told.join(again, ["h", "g"]).select("tid", "start"))
    starts = twice.groupBy("tid").agg(F.collect_list("start").alias("starts"))
    # the one that stands for its copies needs no answer of its own
    kept = copied.select(F.col("first").alias("tid"))
    starts = shared.written(starts.join(kept, "tid", "left_anti").join(profile.select("tid", "doc_id", *same), "tid"), "repeated-windows")
    cut = _with_text(docs, starts).select("tid", "doc_id", "one", "starts", "text").mapInArrow(
        _cut, "tid long, doc_id long, n_removed long, kept binary, one long, two long, n_words long").dropDuplicates(["tid"])
    rows = profile.drop("keys", "spans", "weights").join(copied.drop("first"), same, "left")
    return rows, cut


def repeat_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    rows, cut = shortened(docs)
    cut = cut.select("tid", "n_removed", F.sha2("kept", 256).alias("cut_sha"))
    all_gone = F.col("copies").isNotNull()
    return rows.join(cut, "tid", "left").select(
        "doc_id", "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all columns; texts that lose words become their kept words joined by one space, others stay as they
    are. A text is put back by its id, that of a row without doc_id by the identity of its words."""
    def kept():
        rows, cut = shortened(docs)
        identity = [F.when(F.col("doc_id").isNull(), F.col(c)).alias(c) for c in IDENTITY]
        gone = rows.filter("copies IS NOT NULL").select(F.col("doc_id").alias("__id"), *identity, F.lit("").alias("__kept"))
        return gone.unionAll(cut.select(F.col("doc_id").alias("__id"), *identity, F.decode("kept", "UTF-8").alias("__kept")))
    changed = shared.settled(docs.sparkSession, kept, "kept-words")
    named, nameless = changed.filter("__id IS NOT NULL").select("__id", "__kept"), changed.filter("__id IS NULL")
    if nameless.isEmpty():
        return shared.retexted(docs, named)
    own = _nameless(docs).withColumn("doc_id", F.struct(*(F.col(f"__{c}").alias(c) for c in IDENTITY))).select(docs.columns)
    own = shared.retexted(own, nameless.select(F.struct(*IDENTITY).alias("__id"), "__kept"))
    own = own.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    return shared.retexted(docs.filter("doc_id IS NOT NULL"), named).unionByName(own)
