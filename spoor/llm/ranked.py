"""Ranked lexical search by the Best Position Algorithm.

A term is a maximal run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A document's score for an item
adds up, over the item's distinct terms, the term's weight times a factor of the term's frequency and the text's length.

1. One pass over the texts counts the terms of the items, and no others, in every document.
2. Documents are packed into shards. A shard holds, for each term, its impact list (documents by falling factor), and for
   direct access each document's entries with their positions in those lists. Shards are stored as a table.
3. In a shard an item's lists are read in parallel from their heads, a few entries at a time. Each new document's entries
   in all lists are fetched directly, which gives its score and marks its positions as seen. The best position of a list is
   the end of its seen prefix: whatever is unseen lies behind all best positions, so the sum of the impacts there bounds
   the score of every unseen document. Reading stops when that bound is strictly below the k-th best score (equal scores
   are decided by doc_id). A few shards are searched first; their k-th best scores are a floor for all others.
4. Spark merges the best k of all shards.

Items go through in batches whose terms, at most about TERMS and TERM_BYTES, travel with the tasks. No list, shard or
counter grows beyond its shard; documents are neither shuffled nor compared.

Defined results: a null or empty text has no terms and is never found; rows without doc_id count in the statistics but are
not returned; rows that share a doc_id are documents each for itself; rows without item_id are no items, rows that share an
item_id are one item with the terms of all; items without terms, or whose terms occur nowhere, give no rows; empty tables
give an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm import shared, text

TOP = 10
SHARD_ROWS, SHARD_ENTRIES = 8192, 4 << 20
FIRST_SHARDS = 8                          # searched before the others
STEP = 8                                  # entries read of every list at once, doubled each time
TERMS, TERM_BYTES = 200_000, 16 << 20     # of one batch of items
BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False


# ---- terms ---------------------------------------------------------------------------------------------------------

def _terms(data: np.ndarray, offsets: np.ndarray, hasher: text.SpanHasher):
    """(the distinct terms of a piece, for every term in the piece its number among them, bounds by row)."""
    starts, ends, bounds = text.words(data, offsets, between=BETWEEN)
    first, which = text.grouped(data, starts, ends, hasher)
    raw = text.LOWER[data].tobytes()
    return [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())], which, bounds


def _item_terms(batches):
    hasher = text.SpanHasher(41, lower=True)
    for batch in batches:
        for a, b, data, offsets in text.pieces(batch.column(1)):
            distinct, which, bounds = _terms(data, offsets, hasher)
            row = np.repeat(np.arange(b - a), np.diff(bounds))
            pairs = np.unique(np.stack([row, which]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(pairs[0])),
                                              pa.array(distinct, pa.binary()).take(pa.array(pairs[1]))], ["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct (item_id, term) of the items (item_id, text)."""
    rows = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_item_terms, "item_id long, term binary").distinct()


def _counts(vocabulary: dict[bytes, int]):
    def count(batches):
        hasher, size = text.SpanHasher(41, lower=True), max(1, len(vocabulary))
        for batch in batches:
            for a, b, data, offsets in text.pieces(batch.column(1)):
                distinct, which, bounds = _terms(data, offsets, hasher)
                number = np.fromiter((vocabulary.get(t, -1) for t in distinct), np.int64, len(distinct))[which]
                row = np.repeat(np.arange(b - a), np.diff(bounds))
                key, times = np.unique((row * size + number)[number >= 0], return_counts=True)
                edge = np.searchsorted(key, np.arange(b - a + 1) * size)
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds).astype(np.int64)), cut((key % size).astype(np.int32)),
                     cut(times.astype(np.int32))], ["doc_id", "n", "terms", "times"])
    return count


def _holders(size: int):
    def holders(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])
    return holders


# ---- shards of impact lists ----------------------------------------------------------------------------------------

def factors(n: np.ndarray, times: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The factor of every entry: n the length of its text, times its frequency; below 10^6."""
    if int(n.max(initial=0)) * documents * 90 >= 1 << 63:
        n = n.astype(object)
    m = (10 + 90 * n * documents // length).astype(np.int64)
    times = times.astype(np.int64)
    return (1_000_000_000 * times // (1000 * times + 8 * m)).astype(np.int32)


_INDEX = ("shard long, docs binary, lists binary, bounds binary, read_docs binary, read_factors binary, rows binary, row_lists binary, "
          "row_places binary")


def build_shard(docs: np.ndarray, sizes: np.ndarray, terms: np.ndarray, factor: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a shard: docs (ids), sizes (entries of each document), and term and factor of every entry."""
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    order = np.lexsort((-factor, terms))
    lists, bounds = np.unique(terms[order], return_index=True)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return {"docs": docs, "lists": lists.astype(np.int32), "bounds": np.append(bounds, len(order)).astype(np.int64),
            "read_docs": doc[order], "read_factors": factor[order], "rows": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
            "row_lists": np.searchsorted(lists, terms).astype(np.int32), "row_places": place}


def _shards(documents: int, length: int):
    def build(batches):
        from pyspark import TaskContext
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[tuple] = []

        def flush():
            nonlocal number
            ids, n, terms, times = (np.concatenate([h[i] for h in held]) for i in range(4))
            sizes = np.concatenate([h[4] for h in held])
            held.clear()
            arrays = build_shard(ids, sizes, terms, factors(np.repeat(n, sizes), times, documents, length))
            number += 1
            return pa.RecordBatch.from_pylist([{"shard": number - 1} | {k: v.tobytes() for k, v in arrays.items()}],
                                              pa.schema([("shard", pa.int64()), *((k, pa.binary()) for k in arrays)]))

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                raw = part.column(2).to_pylist()
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), np.frombuffer(b"".join(raw), np.int32),
                             np.frombuffer(b"".join(part.column(3).to_pylist()), np.int32), np.array([len(r) // 4 for r in raw], np.int64)))
                if sum(len(h[0]) for h in held) >= SHARD_ROWS or sum(len(h[2]) for h in held) >= SHARD_ENTRIES:
                    yield flush()
        if held:
            yield flush()
    return build


class Shard:
    """A stored shard, ready to be searched."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.seen = np.zeros(len(self.read_docs), bool)
        self.met = np.zeros(len(self.docs), bool)
        self.weights = np.zeros(len(self.lists), np.int64)
        self.read = self.fetched = 0                    # entries read from lists, entries fetched directly

    def best(self, terms: np.ndarray, weight: np.ndarray, k: int = TOP, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the k best documents with a score of at least `floor` and above 0."""
        at = np.searchsorted(self.lists, terms)
        has = at < len(self.lists)
        has[has] = self.lists[at[has]] == terms[has]
        has &= weight > 0
        mine, weight = at[has], weight[has]
        begin, end = self.bounds[mine], self.bounds[mine + 1]
        self.weights[mine] = weight
        position, touched, met = begin.copy(), [], []
        top_docs, top_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, STEP
        while len(mine):
            low, high = np.minimum(begin + depth, end), np.minimum(begin + depth + step, end)
            depth, step = depth + step, 2 * step
            heads = _ranges(low, high)
            self.read += len(heads)
            new = self.read_docs[heads]
            new = np.unique(new[~self.met[new]])
            self.met[new] = True
            met.append(new)
            # direct access: the new documents' entries in the item's lists
            first, last = self.rows[new], self.rows[new + 1]
            every, owner = _ranges(first, last), np.repeat(np.arange(len(new)), last - first)
            w = self.weights[self.row_lists[every]]
            some = w > 0
            places = self.row_places[every[some]]
            self.fetched += len(places)
            self.seen[places] = True
            touched.append(places)
            score = np.zeros(len(new), np.int64)
            np.add.at(score, owner[some], w[some] * self.read_factors[places])
            top_docs, top_scores = np.concatenate([top_docs, self.docs[new]]), np.concatenate([top_scores, score])
            first = np.lexsort((top_docs, -top_scores))[:k]
            top_docs, top_scores = top_docs[first], top_scores[first]
            for i in np.flatnonzero(position < end).tolist():          # the ends of the seen prefixes
                unseen = self.seen[position[i]:end[i]].argmin()
                position[i] = end[i] if self.seen[position[i] + unseen] else position[i] + unseen
            open_ = position < end
            bound = int((weight[open_] * self.read_factors[position[open_]]).sum())
            if bound <= 0 or bound < max(floor, int(top_scores[-1]) if len(top_scores) == k else 0):
                break
        for x in touched:
            self.seen[x] = False
        for x in met:
            self.met[x] = False
        self.weights[mine] = 0
        good = (top_scores > 0) & (top_scores >= floor)
        return top_docs[good], top_scores[good]


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from first to last (exclusive), range by range."""
    size = last - first
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + size, size)


_TYPES = {"docs": np.int64, "lists": np.int32, "bounds": np.int64, "read_docs": np.int32, "read_factors": np.int32, "rows": np.int64,
          "row_lists": np.int32, "row_places": np.int32}


def _search(items: dict[int, tuple[np.ndarray, np.ndarray]], floors: dict[int, int], k: int):
    def search(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({name: np.frombuffer(batch.column(name)[row].as_py(), kind) for name, kind in _TYPES.items()})
                found = [(item, *shard.best(terms, weight, k, floors.get(item, 0))) for item, (terms, weight) in items.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                     *(pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (1, 2))], ["item_id", "doc_id", "score"])
    return search


# ---- operator ------------------------------------------------------------------------------------------------------

def weight_of(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impact_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[DataFrame, np.ndarray]:
    """(the stored shards over the terms of `vocabulary`, the terms' weights)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = shared.written(rows.mapInArrow(_counts(vocabulary), "doc_id long, n long, terms binary, times binary").filter("n > 0"), "term-counts")
    documents, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select("terms").mapInArrow(_holders(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in held.collect():                     # a row per term of the vocabulary at most
        weights[term] = weight_of(documents, df)
    shards = counted.filter("doc_id IS NOT NULL AND length(terms) > 0").mapInArrow(_shards(documents, length), _INDEX)
    return shared.written(shards, "impact-lists"), weights


def _batch(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score) of the best k of every shard for the items of one batch."""
    rows = pairs.collect()
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
    index, weights = impact_index(docs, vocabulary)
    of_item: dict[int, list[int]] = {}
    for r in rows:
        of_item.setdefault(r.item_id, []).append(vocabulary[bytes(r.term)])
    items = {i: (np.sort(np.array(t)), weights[np.sort(np.array(t))]) for i, t in sorted(of_item.items())}
    schema = "item_id long, doc_id long, score long"
    few = [r.shard for r in index.select("shard").orderBy("shard").limit(FIRST_SHARDS).collect()]
    first = shared.written(index.filter(F.col("shard").isin(few)).mapInArrow(_search(items, {}, k), schema), "first-found")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    kth = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
    floors = {r.item_id: r.score for r in kth.collect()}                # a number an item
    rest = index.filter(~F.col("shard").isin(few)).mapInArrow(_search(items, floors, k), schema)
    return first.unionAll(rest)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank from 1, doc_id, score of each item's k best documents."""
    pairs = shared.written(item_terms(items), "item-terms")
    n, size = pairs.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    batches = max(1, -(-n // TERMS), -(-size // TERM_BYTES))
    found = None
    for b in range(batches):
        part = _batch(docs, pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b), k)
        found = part if found is None else found.unionAll(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
