"""Line dedup: a sharded minimal perfect hash over all distinct line hashes indexes fingerprint, count and last-holder
arrays. Documents probe these arrays, chunk by chunk; lines are never joined with lines.

A line's key is the line without white space at either end, A-Z lower-cased. A key of at least `min_chars` code points
held by at least `min_docs` documents loses all its lines except in the largest doc_id that holds it.

A line is known by 128 bits, two hashes of different construction; counts are kept whole.

Defined results: a null or empty text is one empty line; every row counts as a document, and each row that shares a doc_id
with others is answered by its own text; a row without doc_id loses none (it has no place in the order) but counts as a
holder; an empty table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm import shared, text

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 1 << 17      # distinct lines of one shard
CHUNK_ROWS = 2000         # documents that probe together, so a frequent line is asked for once per chunk
_U = np.uint64


# ---- minimal perfect hash ------------------------------------------------------------------------------------------

def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (text.mix(keys + text.constants(level + 31, 1)[0]) % _U(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of a minimal perfect hash over distinct keys: a key owns a slot of the first level where it is alone.
    Returns the levels' sizes and all their slots as one array of booleans."""
    sizes, levels = [], []
    while len(keys):
        size = max(8, int(len(keys) * 1.5))
        at = _place(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        keys = keys[~alone[at]]
    return np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool)


def positions(keys: np.ndarray, sizes: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Index 0..n-1 of every key; -1 where no level has a slot for it (such a key is not in the set)."""
    rank = np.cumsum(slots) - 1
    out, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        at = start + _place(keys[open_], level, size)
        found = slots[at]
        out[open_[found]] = rank[at[found]]
        open_, start = open_[~found], start + size
    return out


# ---- operator ------------------------------------------------------------------------------------------------------

def _keys(data, offsets, hasher):
    """Lines of a piece: spans, bounds per row, hash, fingerprint (64 bits of another construction), code points of the key."""
    starts, ends, bounds = text.lines(data, offsets)
    s, e = text.stripped(data, starts, ends)
    return starts, ends, bounds, *hasher.both(data, s, e), text.characters(data, s, e)


def _hasher():
    return text.SpanHasher(3, lower=True)


def _both(h: np.ndarray, m: np.ndarray) -> np.ndarray:
    """One number a pair, by which the index places it; the fingerprints in the index tell what is not the same."""
    with np.errstate(over="ignore"):
        return text.mix(h.view(_U) + text.mix(m.view(_U)))


_PROFILE = "doc_id long, chunk long, n_lines long, sha string, hashes binary, marks binary"


def _profiles(min_chars: int):
    def profile(batches):
        hasher = _hasher()
        for batch in batches:
            ids, chunk = batch.column(0), batch.column(1)
            for a, b, data, offsets in text.pieces(batch.column(2)):
                _, _, bounds, h, m, size = _keys(data, offsets, hasher)
                rows = [[], [], [], []]
                raw = data.tobytes()
                for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    long = size[x:y] >= min_chars
                    held, marks = text.distinct_pairs(h[x:y][long], m[x:y][long])
                    rows[0].append(y - x)
                    rows[1].append(hashlib.sha256(raw[offsets[i]:offsets[i + 1]]).hexdigest())
                    rows[2].append(held.tobytes())
                    rows[3].append(marks.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), chunk.slice(a, b - a), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()),
                     pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())],
                    ["doc_id", "chunk", "n_lines", "sha", "hashes", "marks"])
    return profile


def _flat(batch, ids: int, hashes: int, marks: int):
    """The (id, hash, fingerprint) rows packed in a batch of profiles."""
    h = np.frombuffer(b"".join(batch.column(hashes).to_pylist()), np.int64)
    m = np.frombuffer(b"".join(batch.column(marks).to_pylist()), np.int64)
    count = np.array([len(x) // 8 for x in batch.column(hashes).to_pylist()], np.int64)
    return np.repeat(np.arange(batch.num_rows), count), h, m, batch.column(ids)


def _unpack(batches):
    for batch in batches:
        at, h, m, ids = _flat(batch, 0, 1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(m), ids.take(pa.array(at))], ["h", "m", "doc_id"])


def _build(shard: pa.Table) -> pa.Table:
    """One shard's arrays. Lines are placed by a number made of hash, fingerprint and a salt under which no two share one."""
    h, m = (shard.column(c).to_numpy() for c in ("h", "m"))
    n, salt = len(h), 0
    while len(np.unique(keys := _both(h + salt, m))) < n:
        salt += 1
    sizes, slots = perfect_hash(keys)
    at = positions(keys, sizes, slots)
    mark, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(n, np.min_scalar_type(int(shard.column("n").to_numpy().max())))
    mark[at], count[at] = m, shard.column("n").to_numpy()
    last[at] = shard.column("last").fill_null(-1 << 63).to_numpy()
    pack = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.table({"shard": shard.column("shard").slice(0, 1).combine_chunks(), "salt": [salt], "levels": pack(sizes),
                     "slots": pack(np.packbits(slots)), "marks": pack(mark), "counts": pack(count), "last": pack(last)})


def _asked(chunk: pa.Table) -> pa.Table:
    """The distinct lines of a chunk of documents."""
    parts = [_flat(b, 0, 1, 2) for b in chunk.select(["doc_id", "hashes", "marks"]).to_batches()]
    h, m = text.distinct_pairs(*(np.concatenate([p[i] for p in parts]) for i in (1, 2)))
    return pa.table({"chunk": pa.array(np.full(len(h), chunk.column("chunk")[0].as_py(), np.int64)), "h": h, "m": m})


def _probe(min_docs: int):
    def probe(asked: pa.Table, index: pa.Table) -> pa.Table:
        h, m = asked.column("h").to_numpy(), asked.column("m").to_numpy()
        hit, last = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        if index.num_rows and len(h):
            row = index.to_pylist()[0]
            sizes, marks = np.frombuffer(row["levels"], np.int64), np.frombuffer(row["marks"], np.int64)
            slots = np.unpackbits(np.frombuffer(row["slots"], np.uint8), count=int(sizes.sum())).astype(bool)
            at = positions(_both(h + row["salt"], m), sizes, slots)
            counts = np.frombuffer(row["counts"], f"u{len(row['counts']) // len(marks)}")
            hit = (at >= 0) & (marks[at] == m) & (counts[at] >= min_docs)
            last = np.frombuffer(row["last"], np.int64)[at]
        return pa.table({"chunk": asked.column("chunk").to_numpy()[hit], "h": h[hit], "m": m[hit], "last": last[hit]})
    return probe


def _losses(docs: pa.Table, hits: pa.Table) -> pa.Table:
    """What each document of a chunk loses, as packed pairs of hash and fingerprint; one without a loss gives no row."""
    out: list[list] = [[], [], []]
    if hits.num_rows:
        last = dict(zip(zip(hits.column("h").to_pylist(), hits.column("m").to_pylist()), hits.column("last").to_pylist()))
        common = np.sort(hits.column("h").to_numpy())
        for doc, sha, held, marks in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "sha", "hashes", "marks"))):
            held, marks = np.frombuffer(held, np.int64), np.frombuffer(marks, np.int64)
            some = np.flatnonzero(common[np.minimum(np.searchsorted(common, held), len(common) - 1)] == held) if doc is not None else []
            gone = [p for p in zip(held[some].tolist(), marks[some].tolist()) if last.get(p, doc) != doc] if len(some) else []
            if gone:
                for x, v in zip(out, (doc, sha, np.array(gone, np.int64).tobytes())):
                    x.append(v)
    return pa.table({"doc_id": pa.array(out[0], pa.int64()), "sha": pa.array(out[1], pa.string()), "lost": pa.array(out[2], pa.binary())})


def profiles(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: lines, SHA-256 of the text as it is, and the distinct hashes of its long keys. Rows are dealt into
    chunks one by one, so neither rows without doc_id nor those of one repeated id share one."""
    chunks = max(1, -(-docs.count() // CHUNK_ROWS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).alias("chunk")
    return shared.written(rows.select("doc_id", dealt, "text").mapInArrow(_profiles(min_chars), _PROFILE), "line-profiles")


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h"), F.lit(shards)).alias("shard")


def line_index(profile: DataFrame) -> DataFrame:
    """The sharded index over all distinct line hashes: one row of arrays per shard."""
    counted = shared.written(
        profile.select("doc_id", "hashes", "marks").mapInArrow(_unpack, "h long, m long, doc_id long")
        .groupBy("h", "m").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")), "line-counts")
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    built = counted.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(
        _build, "shard long, salt long, levels binary, slots binary, marks binary, counts binary, last binary")
    return shared.written(built, "line-index").withColumn("shards", F.lit(shards))


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(profiles, the lost lines per doc_id and text that loses any)."""
    profile = profiles(docs, min_chars)
    index = line_index(profile)
    first = index.select("shards").first()
    shards = first[0] if first else 1
    asked = profile.groupBy("chunk").applyInArrow(_asked, "chunk long, h long, m long").withColumn("shard", _shard(shards))
    hits = asked.groupBy("shard").cogroup(index.drop("shards").groupBy("shard")).applyInArrow(
        _probe(min_docs), "chunk long, h long, m long, last long")
    lost = profile.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_losses, "doc_id long, sha string, lost binary")
    return profile, shared.written(lost, "lost-lines").dropDuplicates(["doc_id", "sha"])


def _remaining(batches):
    """Texts without their lost lines; columns: lost pairs, text, doc_id, sha."""
    hasher = _hasher()
    for batch in batches:
        out, dropped = [], []
        lost = batch.column(0).to_pylist()
        for a, b, data, offsets in text.pieces(batch.column(1)):
            starts, ends, bounds, h, m, _ = _keys(data, offsets, hasher)
            for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                pairs = np.frombuffer(lost[a + i], np.int64).reshape(-1, 2)
                gone = np.isin(h[x:y].view(np.int64), pairs[:, 0])
                some, pairs = np.flatnonzero(gone), set(map(tuple, pairs.tolist()))
                gone[some] = [p in pairs for p in zip(h[x:y][some].view(np.int64).tolist(), m[x:y][some].view(np.int64).tolist())]
                out.append(b"\n".join([data[s:e].tobytes() for s, e in zip(starts[x:y][~gone], ends[x:y][~gone])]))
                dropped.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(out, pa.binary()), pa.array(dropped, pa.int64())],
                                         ["doc_id", "sha", "kept", "n_dropped"])


def shortened(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the text, kept text and number of dropped lines of the texts that lose lines, each once."""
    few = shared.only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                      lost.select("doc_id").distinct(), "doc_id")
    few = few.withColumn("sha", F.sha2("text", 256)).join(lost, ["doc_id", "sha"])
    rows = few.dropDuplicates(["doc_id", "sha"]).select("lost", "text", "doc_id", "sha").mapInArrow(
        _remaining, "doc_id long, sha string, kept binary, n_dropped long")
    return rows.select("doc_id", "sha", F.decode("kept", "UTF-8").alias("kept"), "n_dropped")


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the SHA-256 of what is kept."""
    profile, lost = lost_lines(docs)
    cut = shortened(docs, lost).select("doc_id", "sha", "n_dropped", F.sha2("kept", 256).alias("cut_sha"))
    return profile.join(cut, ["doc_id", "sha"], "left").select(
        "doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with lost lines gone from `text` (and `n_chars`, where there is one, brought up to date)."""
    def kept():
        _, lost = lost_lines(docs)
        return shortened(docs, lost).select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"), F.col("kept").alias("__kept"))
    return shared.retexted(docs, shared.settled(docs.sparkSession, kept, "kept-lines"))
