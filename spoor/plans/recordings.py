"""The given tables as binary recordings on disk: one file a stretch of sequence numbers, written by the tasks."""

from __future__ import annotations

import struct
import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import schemas
from spoor.plans import tables as t
from spoor.session import scratch_path
from spoor.sources import container

SPAN = 1 << 14       # sequence numbers of a file
BLOCK_RECORDS = 1000
_PACKED = {"u64": "Q", "address": "Q", "u32": "I", "i32": "i", "enum": "B", "flag": "B"}


def _payloads(kind: int):
    """Rows of a typed table (in schema order, then file and order) as (file, order, type, payload)."""
    fields = schemas.fields(kind)
    words = {name: schemas.ENUMS.get((kind, name)) for name, _ in fields}

    def packed(name, stored, value):
        if stored in _PACKED:
            return struct.pack("<" + _PACKED[stored], words[name].index(value) if words[name] else int(value or 0))
        raw = value.encode() if stored == "text" and value else bytes(value or b"")
        return struct.pack("<I", len(raw)) + raw

    def encode(batches):
        import pyarrow as pa
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[:len(fields)]))
            payload = [b"".join(packed(name, stored, v) for (name, stored), v in zip(fields, row)) for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[len(fields):], pa.array([kind] * batch.num_rows, pa.int32()),
                                              pa.array(payload, pa.binary())], ["file", "order", "type", "payload"])
    return encode


def _block(number: int, records: list[tuple[int, bytes]]) -> bytes:
    data = b"".join(struct.pack("<BI", kind, len(payload)) + payload for kind, payload in records)
    head = struct.pack(container.BLOCK_HEADER, container.BLOCK_MAGIC, 1, 0, 0, number, len(data), len(data), len(records), zlib.crc32(data))
    return head + data + struct.pack(container.FOOTER, container.FOOTER_MAGIC, len(data) + 48, number)


def _writer(folder: str):
    def write(rows):
        import pandas as pd
        from pyarrow import fs
        rows = rows.sort_values(["order", "type"], kind="stable")
        records = list(zip(rows["type"].tolist(), rows["payload"].tolist()))
        path = f"{folder}/{int(rows['file'].iloc[0])}.jkt"
        system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(inner.rsplit("/", 1)[0])
        with system.open_output_stream(inner) as out:
            out.write(struct.pack(container.FILE_HEADER, container.FILE_MAGIC, 2, 1, 8, 0, 1, 0))
            for number, a in enumerate(range(0, len(records), BLOCK_RECORDS), 1):
                out.write(_block(number, records[a:a + BLOCK_RECORDS]))
        return pd.DataFrame({"path": [path], "records": [len(records)]})
    return write


def write_recordings(spark: SparkSession, sf: str) -> list[str]:
    """The events of the whole recording as files of SPAN sequence numbers each; their paths."""
    folder, parts = scratch_path(spark, "recordings"), []
    for name, df in t.all_tables(spark, sf).items():
        if "sequence" not in df.columns or name == "modules":
            continue
        kind = schemas.KIND_OF[name]
        rows = df.select(*(n for n, _ in schemas.fields(kind)), F.expr(f"sequence div {SPAN}").alias("file"), F.col("sequence").alias("order"))
        parts.append(rows.mapInArrow(_payloads(kind), "file bigint, order bigint, type int, payload binary"))
    rows: DataFrame = reduce(DataFrame.unionByName, parts)
    written = rows.groupBy("file").applyInPandas(_writer(folder), "path string, records bigint")
    return sorted(r.path for r in written.collect())
