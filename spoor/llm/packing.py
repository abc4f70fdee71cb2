"""Variable-capacity best-fit packing of documents into training sequences.

Items go in by decreasing length, each into the open bin it fills best. Where none has room, the bin size is opened that
costs least for what it can be expected to hold (its tokens plus a fixed cost a sequence), and in the end every bin is
downsized to the smallest permitted size that holds its contents. A document longer than the largest size is cut into
pieces of that size and a rest.

Only the histogram of lengths decides how bins are filled, and it has no more rows than the largest size has tokens. The
driver packs the histogram, handling all equal bins at once; its plan is bounded by the largest size, whatever the number
of documents. Spark numbers the items of each length (a frequent length is dealt over many shards) and looks up each
item's bin and offset in the plan.

Defined results: a document without tokens, or whose length is null or below 1, is in no bin (bin_id, bin_size and
bin_start are null); repeated rows are packed each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm import shared, text

SIZES = (512, 1024, 2048, 4096)
SEQUENCE_COST = 16        # what a sequence costs besides its tokens, in tokens
SHARD_ROWS = 100_000


class Plan:
    """Where the items of every length go. `moves`: (length, first rank, first bin, items a bin, bin's start), in order of
    length and rank; `bins`: (first bin, final size), in order of bins."""

    def __init__(self, histogram: dict[int, int], sizes=SIZES, sequence_cost: int = SEQUENCE_COST):
        self.sizes = tuple(sorted(sizes))
        self.cost = sequence_cost
        self.left = sorted(histogram.items(), reverse=True)
        self.volume = sum(k * n for k, n in self.left)
        self.moves: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int, int]]] = {}      # room -> [(first bin, end bin, size)]
        self.rooms: list[int] = []
        self.n_bins = 0
        closed = []
        for length, count in self.left:
            rank = 0
            self.volume -= length * count                          # what is still to come after this length
            while rank < count:
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    size = self._size_to_open(length, count - rank)
                    n = -(-(count - rank) // (size // length))
                    self._put(size, self.n_bins, self.n_bins + n, size)
                    self.n_bins += n
                    continue
                room = self.rooms[at]
                first, end, size = self._take(room)
                each = room // length                              # a filled bin stays the best fit while it has room
                full = min(end - first, (count - rank) // each)
                if full:
                    self.moves.append((length, rank, first, each, size - room))
                    self._put(room - each * length, first, first + full, size)
                    rank, first = rank + full * each, first + full
                if rank < count and first < end:                   # too few items for one more bin
                    some = count - rank
                    self.moves.append((length, rank, first, some, size - room))
                    self._put(room - some * length, first, first + 1, size)
                    rank, first = count, first + 1
                if first < end:
                    self._put(room, first, end, size)
        for room, groups in self.open.items():
            closed += [(first, next(s for s in self.sizes if s >= size - room)) for first, _, size in groups]
        self.bins = sorted(closed)

    def _size_to_open(self, length: int, count: int) -> int:
        """The permitted size with the least cost for each token it can be expected to hold: as many of these items as
        fit, and shorter ones in the gap, as far as there are any."""
        def cost(size):
            each = min(size // length, count)
            bins = max(1, count // each)
            held = each * length + min(size - each * length, self.volume / bins)
            return (next(s for s in self.sizes if s >= held) + self.cost) / held
        return min((s for s in self.sizes if s >= length), key=lambda s: (cost(s), s))

    def _put(self, room: int, first: int, end: int, size: int) -> None:
        if room not in self.open:
            insort(self.rooms, room)
        self.open.setdefault(room, []).append((first, end, size))

    def _take(self, room: int) -> tuple[int, int, int]:
        groups = self.open[room]
        group = groups.pop()
        if not groups:
            del self.open[room]
            self.rooms.pop(bisect_left(self.rooms, room))
        return group


def _cut(df: DataFrame, largest: int) -> DataFrame:
    """doc_id, piece, start, length of every item; a document without tokens is one item of length 0."""
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("n") - 1) / largest), F.lit(0).cast("long")))
    rows = df.select("doc_id", F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")).alias("n"))
    return rows.select("doc_id", "n", F.explode(pieces).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).alias("length"))


def pack(lengths: DataFrame, sizes=SIZES, sequence_cost: int = SEQUENCE_COST) -> DataFrame:
    """lengths (doc_id, length) -> doc_id, piece, start (in the document), length, bin_id, bin_size, bin_start."""
    items = shared.written(_cut(lengths, max(sizes)), "items")
    counts = items.filter("length > 0").groupBy("length").count().collect()          # at most max(sizes) rows
    plan = Plan({r["length"]: r["count"] for r in counts}, sizes, sequence_cost)
    shards = max(1, -(-sum(r["count"] for r in counts) // SHARD_ROWS))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    before = dealt.groupBy("length", "shard").count().select(
        "length", "shard", (F.sum("count").over(Window.partitionBy("length").orderBy("shard")) - F.col("count")).alias("before"))
    ranked = dealt.withColumn("row", F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece"))).join(
        F.broadcast(before) if shards <= 16 else before, ["length", "shard"])
    moves = np.array(sorted(plan.moves), np.int64).reshape(-1, 5)
    bins = np.array(plan.bins, np.int64).reshape(-1, 2)

    def look_up(batches):
        key = moves[:, 0] << 48 | moves[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 4))
            none = length < 1
            if len(key):
                m = moves[np.maximum(np.searchsorted(key, length << 48 | rank, "right") - 1, 0)]
                nth = rank - m[:, 1]
                bin_, start = m[:, 2] + nth // m[:, 3], m[:, 4] + nth % m[:, 3] * length
                size = bins[np.maximum(np.searchsorted(bins[:, 0], bin_, "right") - 1, 0), 1]
            else:
                bin_ = start = size = np.zeros(len(length), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x, mask=none) for x in (bin_, size, start))],
                                             ["doc_id", "piece", "start", "length", "bin_id", "bin_size", "bin_start"])
    return ranked.select("doc_id", "piece", "start", "length", (F.col("before") + F.col("row") - 1).alias("rank")).mapInArrow(
        look_up, "doc_id long, piece long, start long, length long, bin_id long, bin_size long, bin_start long")


def _count(batches):
    for batch in batches:
        for a, b, data, offsets in text.pieces(batch.column(1)):
            _, _, bounds = text.words(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds) + 1)], ["doc_id", "length"])


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and length: the words of the text and one end mark. Any other measure, such as the token counts of the
    token files, can be packed as well."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _count, "doc_id long, length long")
