"""Is a recording complete? Summaries, profiles and checks."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor import schemas
from spoor.functions import bytes as B
from spoor.operators import ordered
from spoor.operators.evidence import is_sample

# Record types without a sequence number and without a clock value.
STATIC = (1, 3, 10, 14, 16)
UNTIMED = (3, 10, 14, 16)


def run_summary(evidence: DataFrame, run: DataFrame | None = None, incomplete: DataFrame | None = None) -> DataFrame:
    """One row per run; ``run`` adds ``finished``, (run_id, incomplete) adds ``incomplete``."""
    dynamic = F.col("seq") > 0
    rows = evidence.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.min(F.when(dynamic, F.col("seq"))), F.lit(0)).alias("first_seq"),
        F.greatest(F.max("seq"), F.lit(0)).alias("last_seq"),
        F.count_if(F.col("kind") == 18).alias("diagnostics"),
        F.count_if(dynamic).alias("_dynamic"),
        F.coalesce(F.max(F.when(F.col("kind") == 5, F.col("requested"))), F.lit(0)).alias("max_width"),
        F.count_if(is_sample()).alias("captured_samples"))
    rows = rows.withColumn("missing", F.greatest(F.lit(0), F.col("last_seq") - F.col("_dynamic"))).drop("_dynamic")
    if run is not None:
        ended = run.groupBy("run_id").agg(F.max(~F.col("started")).alias("finished"))
        rows = rows.join(ended, "run_id", "left").withColumn("finished", F.coalesce("finished", F.lit(False)))
    if incomplete is not None:
        rows = rows.join(incomplete, "run_id", "left").withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))
    return rows


def record_profile(evidence: DataFrame) -> DataFrame:
    return (evidence.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("records"))
            .withColumn("dataset", F.element_at(F.create_map(
                *[F.lit(v) for k, n in schemas.NAMES.items() for v in (k, n)]), F.col("kind"))))


def container_profile(records: DataFrame) -> DataFrame:
    """Count and decoded bytes per type of raw container records (path, type, payload)."""
    return records.groupBy("path", "type").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("payload") + 5).alias("decoded_bytes"))


def time_profile(evidence: DataFrame) -> DataFrame:
    """Events, instructions and memory-API calls per monotonic second, relative to the first second."""
    timed = evidence.filter(~F.col("kind").isin(*UNTIMED))
    per_second = timed.groupBy("run_id", F.expr("ns div 1000000000").alias("_at")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == 4).alias("instructions"),
        F.count_if(F.col("kind") == 15).alias("memory_api"))
    start = timed.groupBy("run_id").agg(F.expr("min(ns) div 1000000000").alias("_first"))
    return per_second.join(start, "run_id").select(
        "run_id", (F.col("_at") - F.col("_first")).alias("second"), "events", "instructions", "memory_api")


def time_span(evidence: DataFrame) -> DataFrame:
    timed = evidence.filter(~F.col("kind").isin(*UNTIMED))
    return timed.groupBy("run_id").agg((F.max("ns") - F.min("ns")).alias("span_ns"))


def context_change_histogram(changes: DataFrame) -> DataFrame:
    return changes.groupBy("run_id", "info").agg(F.count(F.lit(1)).alias("changes"))


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("run_id", "reason").agg(F.count(F.lit(1)).alias("diagnostics"))


def sequence_audit(evidence: DataFrame) -> DataFrame:
    """Duplicates and gaps from counts alone, without a global order.

    Distinct numbers are counted exactly as bits of words of 64 numbers. A word is a plain number, which the aggregation
    keeps in managed memory and spills, so runs that are thin over a long range take no more than their rows.
    """
    rows = evidence.filter(F.col("seq") > 0)
    words = rows.groupBy("run_id", F.expr("seq div 64").alias("_word")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("seq").alias("_last"),
        F.bit_count(F.expr("bit_or(shiftleft(1L, CAST(seq % 64 AS INT)))")).cast("bigint").alias("_distinct"))
    return words.groupBy("run_id").agg(
        F.sum("_n").alias("records"), F.sum("_distinct").alias("distinct_seqs"), F.max("_last").alias("last_seq"),
        (F.sum("_n") - F.sum("_distinct")).alias("duplicates"), (F.max("_last") - F.sum("_distinct")).alias("gaps"))


def run_verdict(audit: DataFrame, run: DataFrame, incomplete: DataFrame | None = None,
                errors: DataFrame | None = None) -> DataFrame:
    """complete = clean end, one start, one finish, no errors, gaps or duplicates."""
    ends = run.groupBy("run_id").agg(F.count_if(F.col("started")).alias("starts"),
                                     F.count_if(~F.col("started")).alias("finishes"))
    rows = audit.join(ends, "run_id", "left")
    for extra, name, missing in ((incomplete, "incomplete", F.lit(False)), (errors, "errors", F.lit(0))):
        rows = rows.join(extra, "run_id", "left") if extra is not None else rows.withColumn(name, missing)
        rows = rows.withColumn(name, F.coalesce(name, missing))
    good = ((F.coalesce("starts", F.lit(0)) == 1) & (F.coalesce("finishes", F.lit(0)) == 1) & ~F.col("incomplete")
            & (F.col("errors") == 0) & (F.col("gaps") == 0) & (F.col("duplicates") == 0))
    return rows.withColumn("complete", good)


def write_pairing_audit(evidence: DataFrame, threads: DataFrame, segment: int | None = None) -> DataFrame:
    """Memory writes whose before/after samples do not pair up.

    Per (thread, instruction, operand) a write_before is pending until its write_after. ``times`` counts
    repeated notices of one pending write (context changes between it and the next sample), so no list
    of pending-write/context-change pairs is ever built. Multi-element writes (same operand, other
    element) replace silently and only report at thread end.
    """
    ends = threads.filter(~F.col("started")).select(
        "run_id", F.col("thread_id").alias("tid"), F.col("sequence").alias("_end")).groupBy(
        "run_id", "tid").agg(F.max("_end").alias("_end"))
    have = evidence.columns
    multi = F.col("multi_element") if "multi_element" in have else F.lit(False)
    rows = evidence.filter(((F.col("kind") == 5) & F.col("access").isin("write_before", "write_after"))
                           | (F.col("kind") == 13)).select(
        "run_id", "kind", "seq", "tid", "iid", "operand", "element", "addr", "requested", "access",
        multi.alias("multi"))
    rows = ordered.running_sum(rows, ["run_id", "tid"], (F.col("kind") == 13).cast("int"), "_changes",
                               segment=segment)
    all_changes = rows.groupBy("run_id", "tid").agg(F.max("_changes").alias("_all_changes"))
    slot = ["run_id", "tid", "iid", "operand", "multi", "_slot"]
    writes = rows.filter("kind = 5").withColumn(
        "_slot", F.when(F.col("multi"), F.col("element")).otherwise(F.lit(0).cast("bigint")))
    state = F.struct("seq", "access", "addr", "requested", "_changes")
    writes = ordered.carry_many(writes, [(slot, F.lit(True), state, "_last")], segment=segment)
    mirrored = writes.withColumn("_mirror", F.lit(ordered.LAST) - F.col("seq"))
    writes = ordered.carry_last(mirrored, slot, F.lit(True), F.struct("seq", "_changes"), "_next",
                                order="_mirror", segment=segment).drop("_mirror")
    writes = writes.join(all_changes, ["run_id", "tid"], "left").join(ends, ["run_id", "tid"], "left")
    before, after = F.col("access") == "write_before", F.col("access") == "write_after"
    pending = F.col("_last.access") == "write_before"
    single = ~F.col("multi")
    cut = F.coalesce("_next._changes", "_all_changes") - F.col("_changes")

    def notice(condition, reason, seq, address, requested, times):
        return F.when(condition, F.struct(
            F.lit(reason).alias("reason"), seq.alias("notice_seq"), address.alias("address"),
            requested.alias("requested"), times.cast("bigint").alias("times")))

    one, zero = F.lit(1), F.lit(0)
    unfinished = before & F.col("_next").isNull() & F.col("_end").isNotNull()
    notices = F.array_compact(F.array(
        notice(single & before & F.coalesce(pending, F.lit(False)), "write_after_unobserved_before_reexecution",
               F.col("seq"), F.col("_last.addr"), F.col("_last.requested"), one),
        notice(single & after & ~F.coalesce(pending, F.lit(False)), "write_after_without_before",
               F.col("seq"), F.lit(0).cast(B.U64), zero.cast("bigint"), one),
        notice(single & before & (cut > 0), "write_interrupted_by_context_change",
               F.col("seq"), F.col("addr"), F.col("requested"), cut),
        notice(single & unfinished, "write_after_unobserved_at_thread_end",
               F.col("_end"), F.col("addr"), F.col("requested"), one),
        notice(~single & unfinished, "element_write_after_unobserved_at_thread_end",
               F.col("_end"), F.col("addr"), F.col("requested"), one)))
    return (writes.select("run_id", "tid", "iid", "operand", F.explode(notices).alias("n"))
            .select("run_id", "tid", "iid", "operand", "n.*"))


def check_memory_oracle(expected: DataFrame, evidence: DataFrame, diagnostics: DataFrame,
                        instructions: DataFrame, segment: int | None = None) -> DataFrame:
    """Expected slots (run_id, address, slot_kind slot/byte/fault, expected) against recorded samples.

    Samples alternate write_before and write_after; sample i (from 0) holds (i + 1) div 2, full width,
    all by the slot's first thread. A fault slot needs a memory_unreadable diagnostic and only empty
    write_before samples. One row per slot with its number of errors and observed writes.

    Lists of slots and of code grow with the recording, and Spark takes exploded rows for as small as their source:
    the joins are merge joins, so that none of them passes through the driver.
    """
    slots = (expected.groupBy("run_id", "address").agg(
        F.max("expected").alias("expected"), F.max("slot_kind").alias("slot_kind"))
        .withColumn("width", F.when(F.col("slot_kind") == "byte", 1).otherwise(8)))
    known = instructions.select("run_id", "iid").distinct().withColumn("_known", F.lit(True))
    samples = (evidence.filter((F.col("kind") == 5) & F.col("access").isin("write_before", "write_after"))
               .select("run_id", F.col("addr").alias("address"), "seq", "tid", "iid", "access", "requested",
                       "captured")
               .join(slots.select("run_id", "address", "slot_kind", "width").hint("merge"), ["run_id", "address"]))
    samples = ordered.ordinals(samples, ["run_id", "address"], "_i", segment=segment)
    samples = samples.join(known.hint("merge"), ["run_id", "iid"], "left")
    leader = samples.groupBy("run_id", "address").agg(F.min_by("tid", "seq").alias("_leader"))
    samples = samples.join(leader.hint("merge"), ["run_id", "address"], "left")
    captured = F.coalesce(F.length("captured"), F.lit(0))
    odd = F.col("_i") % 2 == 1
    held = B.little_unsigned(F.substring(F.col("captured"), F.lit(1), F.lit(8)))
    wrong = ~((F.col("access") == F.when(odd, "write_after").otherwise("write_before"))
              & F.coalesce(held == F.expr("(_i + 1) div 2"), F.lit(False)) & (captured == F.col("width"))
              & (F.col("requested") == F.col("width")) & F.coalesce("_known", F.lit(False))
              & (F.col("tid") == F.col("_leader")))
    fault = F.col("slot_kind") == "fault"
    bad_fault = ~((F.col("access") == "write_before") & (captured == 0))
    seen = samples.groupBy("run_id", "address").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.when(fault, bad_fault).otherwise(wrong)).alias("_wrong"),
        F.count_if(~fault & (F.col("access") == "write_after")).alias("observed"))
    noted = (diagnostics.filter("reason = 'memory_unreadable'").select("run_id", "address").distinct()
             .withColumn("_noted", F.lit(True)))
    rows = slots.join(seen.hint("merge"), ["run_id", "address"], "left").join(noted.hint("merge"), ["run_id", "address"], "left")
    count = F.coalesce("samples", F.lit(0))
    slot_error = F.when(fault, F.col("_noted").isNull() | (count == 0)).otherwise(count != 2 * F.col("expected"))
    return rows.select("run_id", "address", "slot_kind", "expected", count.alias("samples"),
                       F.coalesce("observed", F.lit(0)).alias("observed"),
                       (F.coalesce("_wrong", F.lit(0)) + slot_error.cast("int")).alias("errors"))


# Register names that share an expectation.
_ALIASES = {"rflags": "gflags", "eflags": "gflags", "ymm0": "xmm0", "zmm0": "xmm0"}


def check_register_oracle(expected: DataFrame, evidence: DataFrame, instructions: DataFrame,
                          registers: DataFrame, segment: int | None = None) -> DataFrame:
    """Expected observations (run_id, pc, register, access, ordinal, mask, value) against samples.

    The k-th observation of a place must satisfy value & mask = expected. ``NAME.high`` is the second
    eight bytes. One row per place with observed and expected counts and errors. Merge joins, as exploded rows pass for small.
    """
    place = ["run_id", "pc", "register", "access"]
    alias = F.create_map(*[F.lit(v) for k, n in _ALIASES.items() for v in (k, n)])
    code = instructions.select("run_id", "iid", F.col("address").alias("pc"))
    names = registers.select("run_id", "reg", "register_name")
    seen = (evidence.filter("kind = 6").select("run_id", "iid", "reg", "seq", "access", "captured")
            .join(code.hint("merge"), ["run_id", "iid"]).join(names, ["run_id", "reg"])
            .withColumn("_name", F.coalesce(F.try_element_at(alias, F.col("register_name")), F.col("register_name")))
            .withColumn("lane", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("register", F.when(F.col("lane") == 1, F.concat("_name", F.lit(".high"))).otherwise(F.col("_name")))
            .join(expected.select(*place).distinct().hint("merge"), place, "left_semi"))
    seen = ordered.ordinals(seen, place, "ordinal", segment=segment)
    width = F.when(F.col("_name") == "gflags", F.lit(4)).otherwise(F.lit(8))
    raw = F.substring(F.col("captured"), F.col("lane") * 8 + 1, width)
    got = F.when(F.length(raw) == width, B.to_signed(B.little_unsigned(raw)).cast("bigint"))
    seen = seen.withColumn("got", got).select(*place, "ordinal", "got", F.lit(True).alias("_seen"))
    rows = seen.join(expected.select(*place, "ordinal", "mask", "value").hint("merge"), [*place, "ordinal"], "full_outer")
    signed_mask, signed_value = (B.to_signed(c).cast("bigint") for c in ("mask", "value"))
    right = F.col("got").isNotNull() & F.coalesce(F.col("got").bitwiseAND(signed_mask) == signed_value, F.lit(False))
    return rows.withColumn("_right", right).groupBy(*place).agg(
        F.count_if(F.col("_seen")).alias("observed"), F.count_if(F.col("mask").isNotNull()).alias("expected"),
        F.count_if(F.col("_seen") & ~F.col("_right")).alias("_wrong")).select(
        *place, "observed", "expected",
        (F.col("_wrong") + (F.col("observed") != F.col("expected")).cast("int")).alias("errors"))
