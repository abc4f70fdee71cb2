"""Text column functions shared by the views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path) -> Column:
    """Last component of a / or \\ separated path."""
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def spaced(text) -> Column:
    return F.replace(_col(text), F.lit("_"), F.lit(" "))


def join_arguments(arguments) -> Column:
    """Command line from an argument array; empty or spaced arguments are quoted and escaped."""
    def one(a):
        quoted = F.concat(F.lit('"'), F.regexp_replace(a, r'(["\\])', r"\\$1"), F.lit('"'))
        return F.when((a == "") | a.rlike('[ \t"]'), quoted).otherwise(a)
    return F.concat_ws(" ", F.transform(_col(arguments), one))


def _in_units(n: Column, bits: int, digits: int) -> Column:
    """``n`` (a whole number) as a double in units of 2^bits, with its exact value rounded as C does: halves to even."""
    exact = n.cast("double").cast("bigint")          # above 2^53 a double has fewer digits than n
    scaled = exact.bitwiseAND(F.lit((1 << bits) - 1)) * 10 ** digits
    part, rest, half = F.shiftright(scaled, bits), scaled.bitwiseAND(F.lit((1 << bits) - 1)), 1 << bits - 1
    up = (rest > half) | ((rest == half) & (part % 2 == 1))
    part = part + up.cast("bigint")
    whole = F.shiftright(exact, bits) + F.when(part == 10 ** digits, 1).otherwise(0)
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((part % 10 ** digits).cast("string"), digits, "0"))


def format_bytes(count) -> Column:
    n = _col(count)
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
            .when(n < 1 << 20, F.concat(_in_units(n, 10, 1), F.lit(" KiB")))
            .when(n < 1 << 30, F.concat(_in_units(n, 20, 1), F.lit(" MiB")))
            .otherwise(F.concat(_in_units(n, 30, 2), F.lit(" GiB"))))
