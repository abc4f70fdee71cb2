"""Small frames and hand-written recordings."""

import struct
import zlib
from decimal import Decimal

from spoor import schemas

EMPTY = dict(run_id=1, kind=4, seq=0, ns=0, tid=0, iid=0, mid=0, off=0, addr=0, endaddr=0, operand=0, element=0,
             requested=0, reg=0, access="", cid=0, target=0, captured=None)


def evidence(spark, rows):
    full = []
    for row in rows:
        r = {**EMPTY, **row}
        if "endaddr" not in row:
            r["endaddr"] = r["addr"] + r["requested"]
        for name in ("off", "addr", "endaddr", "target"):
            r[name] = Decimal(r[name])
        full.append(tuple(r[f] for f in schemas.EVIDENCE.fieldNames()))
    return spark.createDataFrame(full, schemas.EVIDENCE)


def encode(kind, values):
    """Payload bytes of one record; values in field order."""
    out = b""
    enums = {n: w for (k, n), w in schemas.ENUMS.items() if k == kind}
    for (name, code), v in zip(schemas.fields(kind), values):
        if code in ("u64", "address"):
            out += struct.pack("<Q", v)
        elif code == "u32":
            out += struct.pack("<I", v)
        elif code == "i32":
            out += struct.pack("<i", v)
        elif code == "enum":
            out += struct.pack("<B", enums[name].index(v) if isinstance(v, str) else v)
        elif code == "flag":
            out += struct.pack("<B", int(v))
        else:
            raw = v.encode() if code == "text" else v
            out += struct.pack("<I", len(raw)) + raw
    return out


def envelope(kind, payload):
    return struct.pack("<BI", kind, len(payload)) + payload


def block(number, data, records, codec=0, flags=0, crc=None, decoded=None):
    head = struct.pack("<4sHBBQIIII", b"JBLK", 1, codec, flags, number, len(data) if decoded is None else decoded,
                       len(data), records, zlib.crc32(data) if crc is None else crc)
    return head + data + struct.pack("<4sIQ", b"KLBJ", len(data) + 48, number)


def container(*blocks):
    return struct.pack("<8sHBBBBH", b"JKEYTRC\0", 2, 1, 8, 0, 1, 0) + b"".join(blocks)


RUN_START = envelope(1, encode(1, [20, 1700000000, 5, 8, "all", 64, 64, True, True]))
RUN_END = envelope(1, encode(1, [20, 1700000000, 9, 8, "all", 64, 64, True, False]))


def sample_values(kind, n):
    """Distinct values for every field of a record type, large enough to need all bytes."""
    words = {name: w for (k, name), w in schemas.ENUMS.items() if k == kind}
    values = []
    for i, (name, code) in enumerate(schemas.fields(kind)):
        x = n * 31 + i
        values.append({
            "u64": x + 1, "address": (1 << 64) - 1 - x, "u32": (1 << 32) - 1 - x, "i32": -x - 1, "flag": x % 2 == 0,
            "text": f"tëxt \"{x}\"", "bytes": bytes([x % 256, 0, 255])}.get(code)
            if code != "enum" else (words[name][x % len(words[name])] if name in words else x % 19))
        if name == "format_version":
            values[-1] = 20
        if name == "pointer_size":
            values[-1] = 8
        if name == "started" and kind == 1:
            values[-1] = n == 0
    return values
