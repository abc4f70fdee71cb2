"""Vector code compression by ball k-means: every part of a vector is coded by the nearest entry of its codebook.

Components become whole numbers, floor(4096 * x); vectors are cut into 8 equal parts, and each part position has a codebook
of 16 entries that six rounds of assignment and averaging refine. An entry and the parts assigned to it are a ball:

* the ball's radius is the largest distance of its parts from the entry; only entries closer to it than twice the radius,
  its neighbours, can win any of its parts;
* parts nearer to the entry than half the way to the nearest neighbour are the stable core: they stay without any work;
* the rest lies in rings: a part at distance d has as candidates just the neighbours within 2 d;
* a ball whose entry and neighbours did not move in the last round keeps all its parts.

All comparisons are made on squared distances in whole numbers, so the codes are those of the plain method. Radii are those
of a block of vectors, which only makes them smaller.

Vectors are packed into blocks with their current codes. A round reads the blocks, writes them with the new codes and the
sums of each entry's parts, and Spark adds the sums up; the driver sees 128 counts and sums. A lost executor costs the
blocks it was working on.

Defined results: vectors that are null or hold null or non-finite components are dropped; the longest vector, made up to a
multiple of 8, sets the length, and shorter ones count as filled up with zeros; rows without vec_id are coded and come last
in the order that picks the first entries, equal vec_ids are ordered by their vectors; fewer than 16 rows give as many
entries; repeated rows are rows each for itself; an error beyond 63 bits is null (numbers beyond 2^27 are computed with
Python's whole numbers, slowly); an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm import shared

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
BLOCK_ROWS = 4096


# ---- one block -----------------------------------------------------------------------------------------------------

def whole(x: np.ndarray) -> np.ndarray:
    """floor(4096 * x), as doubles without a fraction."""
    return np.floor(x.astype(np.float64) * SCALE)


def _kind(largest: float, width: int):
    """The numbers in which squared distances are exact: doubles, 64-bit integers or Python's."""
    square = width * 4 * (largest + 1) ** 2
    return np.float64 if square < 2.0**53 else np.int64 if square < 2.0**63 else object


def _as(x: np.ndarray, kind) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape) if kind is object else x.astype(kind)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


def assign(x: np.ndarray, code: np.ndarray, entries: np.ndarray, moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entries (of equal ones the first) of the parts x, which were coded by `code` before; the squared
    distances to them; and how many distances were computed. `moved`: which entries changed since `code` was found (None:
    the code is any)."""
    own = _squares(x, entries[code])
    out, best, work = code.copy(), own.copy(), len(x)
    between = _squares(entries[:, None], entries[None, :])
    for i in np.unique(code).tolist():
        rows = np.flatnonzero(code == i)
        near = np.flatnonzero((between[i] <= 4 * own[rows].max()) & (np.arange(len(entries)) != i))
        if moved is not None and not moved[i] and not moved[near].any():
            continue
        for j in near[np.argsort(between[i][near], kind="stable")].tolist():       # ring by ring outwards
            rows = rows[4 * own[rows] >= between[i, j]]
            if not len(rows):
                break
            d = _squares(x[rows], entries[j])
            work += len(rows)
            wins = (d < best[rows]) | ((d == best[rows]) & (j < out[rows]))
            out[rows[wins]], best[rows[wins]] = j, d[wins]
    return out, best, work


def _round(codebooks: list[list[list[int]]], moved: list[list[bool]] | None, width: int):
    """Codes of a block's parts (n, 8), their squared distances and the number of computed ones."""
    largest = max((abs(v) for book in codebooks for entry in book for v in entry), default=0)

    def code_block(x: np.ndarray, codes: np.ndarray):
        kind = _kind(max(float(np.abs(x).max(initial=0)), float(largest)), width)
        out, errors, work = codes.copy(), [], 0
        for p, book in enumerate(codebooks):
            entries = np.array(book, object).reshape(len(book), width)
            entries = entries if kind is object else entries.astype(kind)
            found = assign(_as(x[:, p * width:(p + 1) * width], kind), codes[:, p].astype(np.int64), entries,
                           None if moved is None else np.array(moved[p]))
            out[:, p] = found[0]
            errors.append(found[1])
            work += found[2]
        return out, errors, work
    return code_block


# ---- Spark rounds --------------------------------------------------------------------------------------------------

def _components(column, width: int) -> np.ndarray:
    """The vectors of a list column as rows of 8 * width components."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), PARTS * width), flat.dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _blocks(width: int):
    """Rows (vec_id, label, vector) packed into blocks, all parts coded by entry 0 for now."""
    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                x, n = _components(part.column(2), width), part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(0)),
                     pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(1)),
                     pa.array([x.astype("<f8" if x.dtype == np.float64 else "<f4").tobytes()], pa.binary()),
                     pa.array([np.zeros((n, PARTS), np.uint8).tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([0], pa.int64())],
                    ["vec_id", "label", "vectors", "codes", "sums", "work"])
    return pack


def _block(batch, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(batch.column(0)[row])
    raw = batch.column(2)[row].as_py()
    kind = "<f8" if n and len(raw) == n * PARTS * width * 8 else "<f4"
    return whole(np.frombuffer(raw, kind).reshape(n, PARTS * width)), np.frombuffer(batch.column(3)[row].as_py(), np.uint8).reshape(n, PARTS)


def _step(codebooks, moved, width: int):
    """Blocks with their new codes and, for every entry, the number and the sums of its parts."""
    def step(batches):
        code_block = _round(codebooks, moved, width)
        for batch in batches:
            for row in range(batch.num_rows):
                x, codes = _block(batch, row, width)
                new, _, work = code_block(x, codes)
                sums: list[str] = []
                exact = _as(x, object if float(np.abs(x).max(initial=0)) * len(x) >= 2.0**62 else np.int64)
                for p, book in enumerate(codebooks):
                    for j in range(len(book)):
                        mine = exact[new[:, p] == j, p * width:(p + 1) * width]
                        sums += [str(len(mine)), *map(str, mine.sum(axis=0).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, 1) for i in range(3)), pa.array([new.tobytes()], pa.binary()),
                     pa.array([",".join(sums).encode()], pa.binary()), pa.array([work], pa.int64())], batch.schema.names)
    return step


def _added(batches):
    """(slot, total): the sums of a task's blocks, added up."""
    total: list[int] = []
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            part = [int(v) for v in raw.decode().split(",")]
            total = [a + b for a, b in zip(total, part)] if total else part
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(map(str, total)), pa.string())], ["slot", "total"])


def _averaged(blocks: DataFrame, codebooks, width: int):
    """The entries after a round, and which of them moved: floor(sum / count), unused ones stay."""
    rows = blocks.select("sums").mapInArrow(_added, "slot int, total string")
    found = {r.slot: int(r.total) for r in rows.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    new, slot = [], 0
    for book in codebooks:
        entries = []
        for entry in book:
            count = found.get(slot, 0)
            entries.append([found[slot + 1 + i] // count for i in range(width)] if count else entry)
            slot += 1 + width
        new.append(entries)
    return new, [[a != b for a, b in zip(x, y)] for x, y in zip(new, codebooks)]


def _coded(codebooks, moved, width: int):
    def code(batches):
        code_block = _round(codebooks, moved, width)
        for batch in batches:
            for row in range(batch.num_rows):
                x, codes = _block(batch, row, width)
                new, errors, _ = code_block(x, codes)
                error = [sum(int(e[i]) for e in errors) for i in range(len(x))] if errors and errors[0].dtype == object else (
                    sum(e.astype(np.int64) for e in errors).tolist())
                text = new.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row].values, batch.column(1)[row].values,
                     pa.array([text[i:i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()),
                     pa.array([e if e < 1 << 63 else None for e in error], pa.int64())], ["vec_id", "label", "code", "error"])
    return code


def trained(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list, list | None, int]:
    """(blocks with the codes of the last round, the final codebooks, which entries moved last, width of a part)."""
    x = F.col(vector)
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.filter(x.isNotNull() & usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS)
    first = [r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()]
    padded = [whole(np.array([*v, *[0.0] * (PARTS * width - len(v))])) for v in first]
    codebooks = [[[int(c) for c in v[p * width:(p + 1) * width]] for v in padded] for p in range(PARTS)]
    kind = kept.schema["label"].dataType.simpleString()
    schema = f"vec_id array<long>, label array<{kind}>, vectors binary, codes binary, sums binary, work long"
    blocks, moved = kept.mapInArrow(_blocks(width), schema), None
    for turn in range(ROUNDS):
        after = shared.written(blocks.mapInArrow(_step(codebooks, moved, width), schema), "ball-blocks")
        if turn:
            shared.drop(vectors.sparkSession, blocks)
        blocks = after
        codebooks, moved = _averaged(blocks, codebooks, width)
    return blocks, codebooks, moved, width


def compressed(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error (the errors of all rows of its label) and codebooks_sha256."""
    blocks, codebooks, moved, width = trained(vectors, vector, label)
    kind = blocks.schema["label"].dataType.elementType.simpleString()
    rows = shared.written(blocks.mapInArrow(_coded(codebooks, moved, width), f"vec_id long, label {kind}, code string, error long"), "vector-codes")
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    sums = sums.select(F.col("label").alias("__label"), F.expr("try_cast(label_error AS long)").alias("label_error"))
    if sums.limit(shared.BROADCAST_IDS + 1).count() <= shared.BROADCAST_IDS:
        sums = F.broadcast(sums)
    sha = hashlib.sha256(",".join(str(c) for book in codebooks for entry in book for c in entry).encode()).hexdigest()
    return rows.join(sums, F.col("label").eqNullSafe(F.col("__label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
