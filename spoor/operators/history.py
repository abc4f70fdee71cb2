"""What touched a place, and what it held at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import bytes as B
from spoor.operators.evidence import with_instruction
from spoor.operators.ordered import carry_last, carry_many

_WRITES = ("write_before", "write_after")
_MIN_LEVEL, _MAX_LEVEL = 6, 32   # bucket sizes 2^6 .. 2^32 bytes; a memory width is below 2^32


def newest(df: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    """The ``limit`` newest rows per key; Spark keeps only that many per task before the shuffle."""
    if limit is None:
        return df
    order = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")


def _wanted(writes_only: bool) -> Column:
    return F.col("access").isin(*_WRITES) if writes_only else F.col("access") != "prefetch"


def history_memory(evidence: DataFrame, address: int, size: int, cursor: int, *, writes_only: bool = False,
                   limit: int | None = None, max_width: int | None = None) -> DataFrame:
    """Accesses overlapping [address, address + size) up to the cursor, newest first.

    ``max_width`` (from the run summary) adds the lower address bound that lets Parquet skip row groups.
    """
    start = F.lit(str(address)).cast(B.U64)
    end = F.lit(str(address + size)).cast("decimal(21,0)")
    rows = evidence.filter((F.col("kind") == 5) & (F.col("addr") < end) & (F.col("endaddr") > start)
                           & (F.col("seq") <= cursor) & _wanted(writes_only))
    if max_width is not None:
        rows = rows.filter(F.col("addr") >= F.lit(str(max(0, address - max_width))).cast(B.U64))
    rows = rows.orderBy(F.col("seq").desc())
    return rows if limit is None else rows.limit(limit)


def _level() -> Column:
    """Smallest bucket level whose bucket is at least as wide as the access."""
    return (F.when(F.col("requested") <= 1 << _MIN_LEVEL, F.lit(_MIN_LEVEL))
            .otherwise(F.length(F.bin(F.col("requested") - 1))).cast("int"))


def _touching(places: DataFrame, watches: DataFrame) -> DataFrame:
    """Every (watch, place) pair that overlaps, each pair once.

    Watches: (watch_id, run_id, address, size, cursor). A place sits in the single bucket of its
    start address at the level of its width; a watch is listed under every bucket a touching place
    could start in. The big side is therefore never multiplied, and a small watch list is broadcast.
    """
    span = "CAST(shiftleft(1L, w_level) AS DECIMAL(20,0))"
    probes = (watches
              .select("watch_id", "run_id", F.col("address").cast(B.U64).alias("address"),
                      F.col("size").cast("int").alias("size"), "cursor",
                      F.explode(F.sequence(F.lit(_MIN_LEVEL), F.lit(_MAX_LEVEL))).alias("w_level"))
              .withColumn("w_bucket", F.expr(
                  f"explode(sequence(greatest(address - {span} + 1, 0BD) div {span}, "
                  f"(address + size - 1) div {span}))")))
    rows = places.withColumn("w_level", _level()).withColumn("w_bucket", F.expr(f"addr div {span}"))
    return (rows.join(probes, ["run_id", "w_level", "w_bucket"])
            .filter((F.col("addr") < F.col("address") + F.col("size")) & (F.col("endaddr") > F.col("address")))
            .drop("w_level", "w_bucket"))


def overlapping(evidence: DataFrame, watches: DataFrame, writes_only: bool = False) -> DataFrame:
    """Every (watch, access up to its cursor) pair that overlaps, each pair once."""
    rows = evidence.filter((F.col("kind") == 5) & _wanted(writes_only))
    return _touching(rows, watches).filter(F.col("seq") <= F.col("cursor"))


def _newest_per_place(evidence: DataFrame, watches: DataFrame, segment: int | None) -> DataFrame:
    """For every watch and every place (address and width) it touches, the newest access up to its cursor.

    Watches meet distinct places only, never accesses; the newest access is then an ordered look-up, so a
    place that was accessed a million times costs its watches one row each.
    """
    place = ["run_id", "addr", "requested"]
    rows = evidence.filter((F.col("kind") == 5) & _wanted(False))
    asks = _touching(rows.select(*place, "endaddr").distinct(), watches).select(
        *place, "endaddr", F.col("cursor").alias("seq"), "watch_id", "address", "size")
    both = rows.select(*place, "seq", "access", "captured").unionByName(asks, allowMissingColumns=True)
    asked = F.col("watch_id").isNotNull()
    both = carry_last(both.withColumn("_tie", asked.cast("int")), place, ~asked,
                      F.struct("seq", "access", "captured"), "_hit", tie=("_tie",), segment=segment)
    return both.filter(asked & F.col("_hit").isNotNull()).select(
        "watch_id", "address", "size", "addr", "endaddr", "_hit.*")


def history_memory_batch(evidence: DataFrame, watches: DataFrame, *, writes_only: bool = False,
                         limit: int | None = None) -> DataFrame:
    return newest(overlapping(evidence, watches, writes_only), ["watch_id"], limit)


def history_register(evidence: DataFrame, registers: DataFrame, name: str, thread: int, cursor: int, *,
                     writes_only: bool = False, limit: int | None = None) -> DataFrame:
    """Observations of a register by one thread, newest first; no thread or unknown name gives none."""
    named = (registers.filter(F.lower("register_name") == name.lower())
             .groupBy("run_id").agg(F.min("reg").alias("reg")))
    rows = evidence.filter((F.col("kind") == 6) & (F.col("tid") == thread) & (F.col("seq") <= cursor)
                           & F.lit(thread >= 0))
    if writes_only:
        rows = rows.filter(F.col("access").isin(*_WRITES))
    rows = rows.join(named, ["run_id", "reg"], "left_semi").orderBy(F.col("seq").desc())
    return rows if limit is None else rows.limit(limit)


def history_calls(evidence: DataFrame, target: int, cursor: int, *, thread: int = -1,
                  limit: int | None = None) -> DataFrame:
    """Calls to a runtime address up to the cursor, newest first."""
    rows = evidence.filter((F.col("kind") == 7) & (F.col("target") == F.lit(str(target)).cast(B.U64))
                           & (F.col("seq") <= cursor))
    if thread >= 0:
        rows = rows.filter(F.col("tid") == thread)
    rows = rows.orderBy(F.col("seq").desc())
    return rows if limit is None else rows.limit(limit)


def events_at(evidence: DataFrame, instructions: DataFrame, module: int, offset: int, cursor: int, *,
              thread: int = -1, limit: int | None = None) -> DataFrame:
    """Newest events of every instruction revision at a module offset."""
    revisions = instructions.filter((F.col("mid") == module) & (F.col("off") == offset)).select("run_id", "iid")
    rows = evidence.filter((F.col("seq") > 0) & (F.col("seq") <= cursor))
    if thread >= 0:
        rows = rows.filter(F.col("tid") == thread)
    rows = rows.join(revisions, ["run_id", "iid"], "left_semi").orderBy(F.col("seq").desc())
    return rows if limit is None else rows.limit(limit)


def byte_state(evidence: DataFrame, watches: DataFrame, segment: int | None = None) -> DataFrame:
    """Newest-wins bytes of each watch at its cursor.

    The newest covering access decides a byte; it is known only if that access captured it. Accesses
    that cover the same part of a watch are reduced to the newest one before any byte is expanded, so
    at most size * (size + 1) / 2 rows per watch survive however hot the place is.
    """
    lo = F.greatest(F.col("addr") - F.col("address"), F.lit(0)).cast("int")
    hi = F.least(F.col("endaddr") - F.col("address"), F.col("size")).cast("int")
    skip = F.greatest(F.col("address") - F.col("addr"), F.lit(0)).cast("bigint")
    piece = F.expr("CASE WHEN _skip < length(captured) THEN "
                   "substring(captured, CAST(_skip AS INT) + 1, hi - lo) ELSE X'' END")
    parts = (_newest_per_place(evidence, watches, segment)
             .select("watch_id", "seq", "access", "captured", lo.alias("lo"), hi.alias("hi"), skip.alias("_skip"))
             .select("watch_id", "lo", "hi", F.struct("seq", "access", F.coalesce(piece, F.expr("X''")).alias("piece"))
                     .alias("hit"))
             .filter(F.col("hi") > F.col("lo")).groupBy("watch_id", "lo", "hi").agg(F.max("hit.seq").alias("seq"),
                                                  F.max_by("hit", "hit.seq").alias("hit")))
    cells = parts.select("watch_id", "lo", "seq", "hit", F.explode(F.expr("sequence(lo, hi - 1)")).alias("at"))
    cells = cells.select("watch_id", "at", "seq", F.struct(
        "seq", F.col("hit.access").alias("access"),
        F.expr("CASE WHEN at - lo < length(hit.piece) "
               "THEN lower(hex(substring(hit.piece, at - lo + 1, 1))) END").alias("byte")).alias("cell"))
    winners = cells.groupBy("watch_id", "at").agg(F.max_by("cell", "seq").alias("cell"))
    found = winners.groupBy("watch_id").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "cell.byte"))).alias("_bytes"),
        F.sort_array(F.collect_set("cell.seq"), asc=False).alias("sources"),
        F.max(F.col("cell.access") == "write_before").alias("before_write"))
    at = F.sequence(F.lit(0), F.col("size").cast("int") - 1)
    values = F.transform(at, lambda i: F.try_element_at(F.col("_bytes"), i))
    return (watches.join(found, "watch_id", "left")
            .withColumn("_values", values)
            .select("watch_id", "run_id", "address", "size", "cursor",
                    B.joined_bytes_text("_values").alias("value"),
                    *_numbers(F.col("_values")),
                    F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"),
                    F.coalesce("before_write", F.lit(False)).alias("before_write")))


def _numbers(values: Column) -> list[Column]:
    """The little-endian number that up to eight known bytes spell, without and with a sign; null for others."""
    known = F.when(~F.exists(values, lambda v: v.isNull()) & (F.size(values) <= 8), F.unhex(F.concat_ws("", values)))
    return [B.little_unsigned(known).alias("number"), B.little_signed(known).alias("signed_number")]


def register_state(evidence: DataFrame, watches: DataFrame, segment: int | None = None) -> DataFrame:
    """Bytes of the newest observation per register watch (watch_id, run_id, reg, tid, offset, size, cursor).

    Observations and watches are one ordered input, so the cost is their sum, however hot a register is.
    """
    keyed = watches.select("watch_id", "run_id", "reg", "tid", F.col("cursor").alias("seq"), "offset", "size")
    rows = evidence.filter(F.col("kind") == 6).select("run_id", "reg", "tid", "seq", "access", "captured")
    asked = F.col("watch_id").isNotNull()
    both = rows.unionByName(keyed, allowMissingColumns=True).withColumn("_tie", asked.cast("int"))
    both = carry_last(both, ["run_id", "reg", "tid"], ~asked, F.struct("seq", "access", "captured"), "hit",
                      tie=("_tie",), segment=segment)
    byte = lambda i: F.when(
        (i + F.col("offset") >= 0) & (i + F.col("offset") < F.length("hit.captured")),
        F.lower(F.hex(F.substring(F.col("hit.captured"), (i + F.col("offset") + 1).cast("int"), F.lit(1)))))
    values = F.transform(F.sequence(F.lit(0), F.col("size").cast("int") - 1), byte)
    return (both.filter(asked).withColumn("_values", values)
            .select("watch_id", "run_id", "reg", "tid", "offset", "size", F.col("seq").alias("cursor"),
                    B.joined_bytes_text("_values").alias("value"),
                    *_numbers(F.col("_values")),
                    F.col("hit.seq").alias("source"),
                    F.coalesce(F.col("hit.access") == "write_before", F.lit(False)).alias("before_write")))


def write_transition(evidence: DataFrame, segment: int | None = None) -> DataFrame:
    """Each write_after sample with its newest earlier write_before sample of the same place.

    Not paired when the instruction was executed again in between by the same thread.
    """
    rows = evidence.filter((F.col("kind") == 4)
                           | (F.col("kind").isin(5, 6) & F.col("access").isin(*_WRITES)))
    rows = rows.select("run_id", "kind", "seq", "tid", "iid", "addr", "reg", "operand", "element", "access",
                       "captured")
    owner = ["run_id", "tid", "iid"]
    rows = carry_many(rows, [
        (owner, F.col("kind") == 4, None, "_ran"),
        ([*owner, "kind", "addr", "reg", "operand", "element"], F.col("access") == "write_before",
         F.struct("seq", "captured"), "_before")], segment=segment)
    before, after = F.col("_before.captured"), F.col("captured")
    outcome = (F.when(F.col("_before").isNull(), "no_before_sample")
               .when(F.col("_ran") > F.col("_before.seq"), "earlier_execution")
               .otherwise("paired"))
    paired = F.col("outcome") == "paired"
    return (rows.filter(F.col("access") == "write_after").withColumn("outcome", outcome)
            .select("run_id", "seq", "kind", "tid", "iid", "addr", "reg", "operand", "element", "outcome",
                    F.when(paired, F.col("_before.seq")).alias("before_seq"),
                    F.when(paired, B.hex_text(before)).alias("before_value"),
                    B.hex_text(after).alias("after_value"),
                    F.when(paired, B.changed_bytes(before, after)).alias("changed"),
                    F.when(paired, F.least(F.length(before), F.length(after))).alias("compared")))


def related_rows(evidence: DataFrame, instructions: DataFrame, seqs: DataFrame) -> DataFrame:
    """Chosen events (run_id, seq) with their instruction definition and, for write_after, the transition."""
    chosen = evidence.join(seqs.select("run_id", "seq").distinct(), ["run_id", "seq"], "left_semi")
    writers = chosen.filter(F.col("access") == "write_after").select("run_id", "tid", "iid").distinct()
    history = evidence.join(writers, ["run_id", "tid", "iid"], "left_semi")
    steps = write_transition(history).select("run_id", "seq", "outcome", "before_seq", "changed", "compared")
    return with_instruction(chosen, instructions).join(steps, ["run_id", "seq"], "left")
