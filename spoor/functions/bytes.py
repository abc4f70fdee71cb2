"""Byte-level column functions: unsigned numbers, hex, little-endian integers, byte patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"
WRAP = 1 << 64


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_unsigned(text) -> Column:
    """Decimal or 0x-hexadecimal text to an unsigned 64-bit number; empty text is 0."""
    t = F.trim(_col(text))
    is_hex = F.lower(F.substring(t, 1, 2)) == "0x"
    return (F.when(t == "", F.lit(0).cast(U64))
            .when(is_hex, F.conv(F.substring(t, 3, 64), 16, 10).cast(U64))
            .otherwise(t.cast(U64)))


def hex_address(number) -> Column:
    """Unsigned number as lower-case 0x text."""
    return F.concat(F.lit("0x"), F.lower(F.conv(_col(number).cast("string"), 10, 16)))


def wrap_unsigned(number) -> Column:
    """Reduce a DECIMAL result to the unsigned 64-bit range."""
    wide = _col(number).cast("decimal(22,0)")
    wrap = F.lit(str(WRAP)).cast("decimal(22,0)")
    return F.when(wide < 0, wide + wrap).when(wide >= wrap, wide - wrap).otherwise(wide).cast(U64)


def to_signed(number) -> Column:
    """Two's-complement reading of an unsigned 64-bit number, as DECIMAL."""
    wide = _col(number).cast("decimal(22,0)")
    return F.when(wide >= F.lit(str(1 << 63)).cast("decimal(22,0)"),
                  wide - F.lit(str(WRAP)).cast("decimal(22,0)")).otherwise(wide)


def hex_text(data) -> Column:
    return F.lower(F.hex(_col(data)))


def _reversed_hex(data: Column) -> Column:
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    return F.concat_ws("", F.reverse(pairs))


def little_unsigned(data) -> Column:
    """Unsigned value of up to 8 little-endian bytes; null when longer or empty."""
    d = _col(data)
    return F.when(F.length(d).between(1, 8), F.conv(_reversed_hex(d), 16, 10).cast(U64))


def little_signed(data) -> Column:
    """Two's-complement value of up to 8 little-endian bytes."""
    d = _col(data)
    value = little_unsigned(d).cast("decimal(22,0)")
    span = F.element_at(F.array(*[F.lit(str(1 << (8 * n))).cast("decimal(22,0)") for n in range(1, 9)]),
                        F.greatest(F.length(d), F.lit(1)))
    return F.when(F.length(d).between(1, 8),
                  F.when(value * 2 >= span, value - span).otherwise(value).cast("decimal(22,0)"))


def changed_bytes(a, b) -> Column:
    """Number of differing bytes over the common prefix length of two samples."""
    x = F.regexp_extract_all(F.hex(_col(a)), F.lit("(..)"), F.lit(1))
    y = F.regexp_extract_all(F.hex(_col(b)), F.lit("(..)"), F.lit(1))
    different = F.zip_with(x, y, lambda p, q: F.when(p != q, 1).otherwise(0))  # null past the shorter one
    return F.aggregate(different, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)))


def latin(data) -> Column:
    """One character per byte, so text functions count bytes."""
    return F.decode(_col(data), "ISO-8859-1")


def joined_bytes_text(values) -> Column:
    """Array of two-digit hex strings (null = unknown) as text, unknown bytes shown as ??."""
    return F.concat_ws(" ", F.transform(_col(values), lambda v: F.coalesce(v, F.lit("??"))))
