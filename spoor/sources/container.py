"""Binary recordings: distributed block index, audit, and decoding to typed tables.

Every file is hopped header by header by the task that owns it (48 bytes read per block); the blocks
found are then spread over the cluster and decoded independently of their file. Records travel as Arrow
buffers with offsets and are unpacked a batch at a time, field by field.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import schemas
from spoor.functions import bytes as B
from spoor.session import path_exists

# Container layout, little endian.
FILE_MAGIC, BLOCK_MAGIC, FOOTER_MAGIC = b"JKEYTRC\0", b"JBLK", b"KLBJ"
FILE_HEADER, FILE_HEADER_SIZE = "<8sHBBBBH", 16
BLOCK_HEADER, BLOCK_HEADER_SIZE = "<4sHBBQIIII", 32
FOOTER, FOOTER_SIZE = "<4sIQ", 16
MAX_BLOCK = 64 * 1024 * 1024
RECORD_HEADER = 5
FILE_NAME = "trace.jkt"

_INDEX = ("path string, block_offset bigint, block_id bigint, codec int, decoded_size bigint, stored_size bigint, "
          "records bigint, crc bigint, status string, problem string, pointer int")


def _open(path: str):
    from pyarrow import fs
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def resolve(spark: SparkSession, path: str) -> str:
    """A directory that holds a container stands for it."""
    inside = f"{path.rstrip('/')}/{FILE_NAME}"
    return inside if path_exists(spark, inside) else path


def hop(path: str, at: int = FILE_HEADER_SIZE, expected: int = 1):
    """Index rows of one file from a block on; stops at the first block that does not follow its predecessor."""
    pointer = None

    def row(offset, status, problem=None, header=(None,) * 6):
        return (path, offset, *header, status, problem, pointer)

    with _open(path) as file:
        head = file.read(FILE_HEADER_SIZE)
        if len(head) < FILE_HEADER_SIZE:
            yield row(0, "Corrupt", "file header")
            return
        magic, version, little, pointer, preferred, block_version, zero = struct.unpack(FILE_HEADER, head)
        if (magic, version, little, block_version, zero) != (FILE_MAGIC, 2, 1, 1, 0) or pointer not in (4, 8) or preferred > 1:
            yield row(0, "Corrupt", "file header")
            return
        size = file.size()
        while at < size:
            file.seek(at)
            raw = file.read(BLOCK_HEADER_SIZE)
            if len(raw) < BLOCK_HEADER_SIZE:
                yield row(at, "Incomplete", "block header")
                return
            magic, version, codec, flags, block, decoded, stored, records, crc = struct.unpack(BLOCK_HEADER, raw)
            header = (block if block < 1 << 63 else -1, codec, decoded, stored, records, crc)
            if (magic, version, flags) != (BLOCK_MAGIC, 1, 0):
                yield row(at, "Corrupt", "block header", header)
                return
            if block != expected or max(decoded, stored) > MAX_BLOCK:
                yield row(at, "Corrupt", "block order or bounds", header)
                return
            footer_at = at + BLOCK_HEADER_SIZE + stored
            if footer_at + FOOTER_SIZE > size:
                yield row(at, "Incomplete", "block cut off", header)
                return
            file.seek(footer_at)
            if struct.unpack(FOOTER, file.read(FOOTER_SIZE)) != (FOOTER_MAGIC, stored + 48, block):
                yield row(at, "Incomplete", "block footer", header)
                return
            yield row(at, "Block" if codec == 0 else "UnsupportedCodec", None, header)
            at, expected = footer_at + FOOTER_SIZE, expected + 1


def _hop_files(batches):
    import pandas as pd
    names = [f.split()[0] for f in _INDEX.split(", ")]
    for batch in batches:
        for path in batch["path"]:
            rows = []
            for row in hop(path):
                rows.append(row)
                if len(rows) == 8192:
                    yield _frame(rows, names)
                    rows = []
            if rows:
                yield _frame(rows, names)


def _frame(rows, names):
    import pandas as pd
    numbers = ["block_offset", "block_id", "codec", "decoded_size", "stored_size", "records", "crc"]
    return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in numbers}).astype({"codec": "Int32", "pointer": "Int32"})


def block_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per block from headers and footers alone."""
    files = spark.createDataFrame([(resolve(spark, p),) for p in paths], "path string")
    return files.repartition(max(1, len(paths)), "path").mapInPandas(_hop_files, _INDEX)


def _payload(file, offset, stored):
    file.seek(offset + BLOCK_HEADER_SIZE)
    return file.read(stored)


def _envelopes(data):
    """Types, starts and sizes of the records of a block; raises ValueError when one does not fit."""
    import numpy as np
    kinds, starts, at, n = bytearray(), [], 0, len(data)
    head = struct.Struct("<BI").unpack_from
    while at < n:
        if n - at < RECORD_HEADER:
            raise ValueError("record header cut off")
        kind, size = head(data, at)
        at += RECORD_HEADER
        if size > n - at:
            raise ValueError("record longer than its block")
        kinds.append(kind)
        starts.append(at)
        at += size
    starts = np.array(starts, np.int64)
    return np.frombuffer(bytes(kinds), np.uint8), starts, np.append(starts[1:] - RECORD_HEADER, n)[:len(starts)] - starts


def checked(data, decoded, records, crc):
    """The records of a block's payload as _envelopes gives them; raises ValueError if anything about it is wrong."""
    if len(data) != decoded:
        raise ValueError("decoded size differs")
    if zlib.crc32(data) != crc:
        raise ValueError("checksum differs")
    found = _envelopes(data)
    if len(found[0]) != records:
        raise ValueError("record count differs")
    return found


def _blocks(rows, visit):
    """Calls ``visit(row, file)`` for every row of the index, keeping one file open at a time."""
    opened, file = None, None
    try:
        for row in rows:
            if row.path != opened:
                if file is not None:
                    file.close()
                opened, file = row.path, _open(row.path)
            yield from visit(row, file)
    finally:
        if file is not None:
            file.close()


def _verify(batches):
    import pandas as pd

    def visit(row, file):
        if row.status != "Block":
            yield row
            return
        try:
            checked(_payload(file, row.block_offset, int(row.stored_size)), row.decoded_size, row.records, row.crc)
            yield row
        except ValueError as error:
            yield row._replace(status="Corrupt", problem=str(error))

    names = [f.split()[0] for f in _INDEX.split(", ")]
    pending = []
    for row in _blocks((row for batch in batches for row in batch.itertuples(index=False)), visit):
        pending.append(tuple(None if isinstance(v, float) and v != v else v for v in row))
        if len(pending) == 4096:
            yield _frame(pending, names)
            pending = []
    if pending:
        yield _frame(pending, names)


def audit_blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The index with checksum, envelope and count verified; a reader stops at the first bad block."""
    index = block_index(spark, paths)
    return index.repartition("path", "block_offset").mapInPandas(_verify, _INDEX)


RECORDS = "path string, block_id bigint, position bigint, type int, payload binary"


def record_batches(path: str, block_id: int, data: bytes, found, rows: int = 65536):
    """The records of a block as Arrow batches of RECORDS. Payloads are one buffer with offsets, no record is an object."""
    import numpy as np
    import pyarrow as pa
    kinds, starts, sizes = found
    unknown = np.setdiff1d(kinds, list(schemas.RECORDS))
    if len(unknown):
        raise ValueError(f"{path}: Unknown record type {unknown[0]}")
    kept = np.ones(len(data), bool)
    kept[(starts[:, None] + np.arange(-RECORD_HEADER, 0)).ravel()] = False              # the envelopes
    body = np.frombuffer(data, np.uint8)[kept]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    payload = pa.Array.from_buffers(pa.binary(), len(kinds), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    for a in range(0, len(kinds), rows):
        n = len(kinds[a:a + rows])
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(path, pa.string()), n), pa.array(np.full(n, block_id, np.int64)), pa.array(np.arange(a, a + n)),
             pa.array(kinds[a:a + n].astype(np.int32)), payload.slice(a, n)], ["path", "block_id", "position", "type", "payload"])


def _decode_blocks(batches):
    from types import SimpleNamespace

    def visit(row, file):
        if row.status == "Incomplete" and row.problem != "block footer":
            return     # a cut tail ends the recording; the records before it count
        if row.status != "Block":
            raise ValueError(f"{row.path}: {row.problem or 'block codec not available'} (block {row.block_id})")
        data = _payload(file, row.block_offset, row.stored_size)
        try:
            found = checked(data, row.decoded_size, row.records, row.crc)
        except ValueError as error:
            raise ValueError(f"{row.path}: {error} (block {row.block_id})") from error
        yield from record_batches(row.path, row.block_id, data, found)
    yield from _blocks((SimpleNamespace(**row) for batch in batches for row in batch.to_pylist()), visit)


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw records of whole blocks; any damage other than a cut tail fails the job."""
    return block_index(spark, paths).repartition("path", "block_offset").mapInArrow(_decode_blocks, RECORDS)


def completeness(index: DataFrame, records: DataFrame) -> DataFrame:
    """Per file: blocks, whether the tail was cut, and whether a run-start record was seen."""
    tails = index.groupBy("path").agg(F.count_if(F.col("status") == "Block").alias("blocks"),
                                      F.max(F.col("status") == "Incomplete").alias("incomplete"),
                                      F.max("pointer").alias("pointer"))
    starts = (records.filter("type = 1").groupBy("path")
              .agg(F.max(F.substring(F.col("payload"), -1, 1) == F.lit(b"\x01")).alias("started")))
    return tails.join(starts, "path", "left").withColumn("started", F.coalesce("started", F.lit(False)))


def check_started(state: DataFrame) -> None:
    missing = state.filter("NOT started").limit(1).collect()
    if missing:
        raise ValueError(f"No run start in {missing[0]['path']}")


# --- field decoding ----------------------------------------------------------------------------------

_FIXED = {"u64": "<i8", "address": "<i8", "u32": "<u4", "i32": "<i4", "enum": "u1", "flag": "u1"}


def _payload_bytes(column):
    """The bytes of a binary column and the bounds of its rows in them."""
    import numpy as np
    _, where, data = column.buffers()
    bounds = np.frombuffer(where, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds[:-1], bounds[1:]


def _gathered(data, begin, size):
    """The bytes of all spans, one after the other, and their bounds."""
    import numpy as np
    total = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)], total


def decoded_columns(kind: int, data, begin, end) -> dict:
    """The fields of records of one type as Arrow arrays. All records are unpacked together, field by field: fixed widths
    from a matrix of bytes, texts and bytes as one buffer with offsets."""
    import numpy as np
    import pyarrow as pa
    at, columns = begin.copy(), {}

    def step(size, what="it ends before its last field"):
        if (at + size > end).any():
            raise ValueError(f"Undecodable record of type {kind}: {what}")

    for name, stored in schemas.fields(kind):
        if stored in _FIXED:
            dtype = np.dtype(_FIXED[stored])
            step(dtype.itemsize)
            values = np.ascontiguousarray(data[at[:, None] + np.arange(dtype.itemsize)]).view(dtype).reshape(-1)
            if stored == "flag" and (values > 1).any():
                raise ValueError(f"Undecodable record of type {kind}: flag byte is neither 0 nor 1")
            columns[name] = pa.array(values.astype({"flag": bool, "i32": np.int32}.get(stored, np.int64)))
            at += dtype.itemsize
            continue
        step(4)
        size = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").reshape(-1).astype(np.int64)
        at += 4
        step(size, "field longer than its record")
        body, bounds = _gathered(data, at, size)
        column = pa.Array.from_buffers(pa.large_string() if stored == "text" else pa.large_binary(), len(at),
                                       [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body))])
        try:
            column.validate(full=True)
        except pa.ArrowInvalid as error:
            raise ValueError(f"Undecodable record of type {kind}: {name} is not UTF-8") from error
        columns[name] = column.cast(pa.string() if stored == "text" else pa.binary())
        at += size
    if (at != end).any():
        raise ValueError("Bytes left over after the last field")
    return columns


def _decoder(kind: int):
    def decode(batches):
        import pyarrow as pa
        for batch in batches:
            found = decoded_columns(kind, *_payload_bytes(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found.values()], ["run_id", "block_id", "position", *found])
    return decode


_WIRE = {"u64": "bigint", "address": "bigint", "u32": "bigint", "i32": "int", "enum": "bigint", "flag": "boolean", "text": "string",
         "bytes": "binary"}


def decode_records(records: DataFrame, kind: int) -> DataFrame:
    """Typed rows of one record type (records need run_id); surplus or missing bytes fail the job.

    Addresses travel as signed 64-bit numbers and become unsigned on the JVM side.
    """
    from spoor.operators.evidence import normalize_enums
    schema = "run_id bigint, block_id bigint, position bigint, " + ", ".join(
        f"{n} {_WIRE[c]}" for n, c in schemas.fields(kind))
    rows = (records.filter(F.col("type") == kind).select("run_id", "block_id", "position", "payload")
            .mapInArrow(_decoder(kind), schema))
    rows = rows.withColumns({n: B.wrap_unsigned(n) for n, c in schemas.fields(kind) if c == "address"} or {"run_id": F.col("run_id")})
    typed = normalize_enums(rows, kind)
    kept = [n for n, _ in schemas.fields(kind)]
    order = F.struct("block_id", "position").alias("ordinal")
    return typed.select("run_id", *kept, order) if kind == 10 else typed.select("run_id", *kept)


def read_container(spark: SparkSession, paths: list[str], staging: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Typed tables and per-run state (run_id, path, blocks, incomplete, started) of several recordings.

    Records are decoded from the blocks once into a table partitioned by record type, which the typed
    tables then read one partition each. Run ids follow the order of ``paths``.
    """
    resolved = [resolve(spark, p) for p in paths]
    ids = spark.createDataFrame([(p, i + 1) for i, p in enumerate(resolved)], "path string, run_id bigint")
    raw = read_records(spark, resolved).join(ids, "path")
    raw.write.mode("errorifexists").partitionBy("type").parquet(staging)
    records = spark.read.schema(raw.schema).parquet(staging)
    state = completeness(block_index(spark, resolved), records).join(ids, "path")
    check_started(state)
    tables = {name: decode_records(records, kind) for kind, name in schemas.NAMES.items()}
    bad = tables["run"].filter(F.col("format_version") != schemas.FORMAT_VERSION).limit(1).count()
    if bad:
        raise ValueError("Only recording format 20 can be read")
    if tables["run"].join(state, "run_id").filter("pointer_size <> pointer").limit(1).count():
        raise ValueError("Pointer sizes of file and run differ")
    return tables, state
