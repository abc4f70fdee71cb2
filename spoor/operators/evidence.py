"""The uniform evidence frame, record normalisation, guards, categories and event views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor import schemas
from spoor.functions import bytes as B
from spoor.functions import text as X

PAGE = 300            # rows of a timeline page

_ACCESS_WORDS = ["read", "read_before", "write_before", "write_after", "prefetch"]


def normalize_enums(df: DataFrame, kind: int) -> DataFrame:
    """Numbers to words, flags to an ``event`` word, ``copied_size`` for memory rows."""
    for (owner, name), words in schemas.ENUMS.items():
        if owner == kind and not isinstance(df.schema[name].dataType, T.StringType):
            n = F.col(name)
            word = F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
            bad = F.raise_error(F.concat(F.lit(f"Number outside enumeration {name}: "), n.cast("string")))
            df = df.withColumn(name, F.when(n.between(0, len(words) - 1), word).otherwise(bad))
    for flag, (on, off) in schemas.FLAG_WORDS.items():
        if flag in df.columns:
            df = df.withColumn("event", F.when(F.col(flag), on).otherwise(off))
    if kind == 5:
        df = df.withColumn("copied_size", F.coalesce(F.length("value_hex"), F.lit(0)).cast("bigint"))
    return df


def _evidence_part(df: DataFrame, kind: int) -> DataFrame:
    have = set(df.columns)

    def number(name, dtype):
        value = F.col(name) if name in have else F.lit(None)
        return F.coalesce(value.cast(dtype), F.lit(0).cast(dtype))

    address = "memory_address" if kind == 5 else "base" if kind == 2 else "address"
    requested = number("requested_size", "bigint") if kind == 5 else F.lit(0).cast("bigint")
    addr = number(address, B.U64)
    sampled = kind in (5, 6)
    return df.select(
        number("run_id", "bigint").alias("run_id"), F.lit(kind).alias("kind"),
        number("sequence", "bigint").alias("seq"), number("monotonic_ns", "bigint").alias("ns"),
        number("thread_id", "bigint").alias("tid"), number("instruction_id", "bigint").alias("iid"),
        number("module_id", "bigint").alias("mid"), number("module_offset", B.U64).alias("off"),
        addr.alias("addr"), (addr + requested).cast("decimal(21,0)").alias("endaddr"),
        number("operand_index", "bigint").alias("operand"),
        number("element_index", "bigint").alias("element"), requested.alias("requested"),
        number("register_id", "bigint").alias("reg"),
        (F.coalesce(F.col("access"), F.lit("")) if sampled else F.lit("")).alias("access"),
        number("call_id", "bigint").alias("cid"), number("target_address", B.U64).alias("target"),
        (F.col("value_hex") if sampled else F.lit(None).cast("binary")).alias("captured"))


def to_evidence(tables: dict[str, DataFrame]) -> DataFrame:
    """One uniform row per record; absent numbers are 0 and static records have sequence 0."""
    parts = [_evidence_part(df, schemas.KIND_OF[name]) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _guards() -> list[tuple[str, Column]]:
    """Problem names of an evidence row and when a row has them."""
    static = F.col("kind").isin(1, 3, 10, 14, 16)
    sampled = F.col("kind").isin(5, 6)
    return [
        ("invalid_sequence", (F.col("seq") < 0) | (~static & (F.col("seq") == 0))),
        ("invalid_memory_width", (F.col("kind") == 5)
         & ((F.col("requested") < F.coalesce(F.length("captured"), F.lit(0)))
            | (F.col("requested") > 0xffffffff))),
        ("invalid_access", sampled & ~F.col("access").isin(*_ACCESS_WORDS)),
    ]


def guard_problems() -> Column:
    """Array of problem names for an evidence row, empty when the row is acceptable."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in _guards()]))


def ingest_rejects(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("problems", guard_problems()).filter(F.size("problems") > 0)


def ingest_strict(evidence: DataFrame) -> DataFrame:
    """The same rows; the job fails at the first unacceptable one."""
    # Without arrays and lambdas, which would keep the rows of whole recordings out of generated code.
    named = [F.when(c, F.lit(n)) for n, c in _guards()]
    failed = F.raise_error(F.concat(F.lit("Rejected evidence row: "), F.concat_ws(",", *named)))
    # Carried on seq so that the check is evaluated whenever the row is used.
    return evidence.withColumn("seq", F.when(F.coalesce(*named).isNotNull(), failed.cast("bigint")).otherwise(F.col("seq")))


def is_sample() -> Column:
    """Memory or register samples that hold bytes (prefetches do not)."""
    return F.col("kind").isin(5, 6) & (F.col("access") != "prefetch")


def in_category(category: str) -> Column:
    """Timeline predicate of one category; an unknown name means all events."""
    kind = F.col("kind")
    return {
        "Writes": kind.isin(5, 6) & (F.col("access") == "write_after"),
        "Calls / returns": kind.isin(7, 8),
        "Control flow": kind.isin(7, 8, 11, 13),
        "Memory lifetime": kind == 15,
        "System / process": kind.isin(9, 12, 13, 17),
        "Capture diagnostics": kind == 18,
    }.get(category, F.lit(True))


def categories() -> Column:
    """All categories a row belongs to."""
    return F.array_compact(F.array(*[F.when(in_category(c), F.lit(c)) for c in schemas.CATEGORIES]))


def categorize(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("category", F.explode(categories()))


def timeline_filter(evidence: DataFrame, category: str = "All events", thread: int = -1) -> DataFrame:
    rows = evidence.filter((F.col("seq") > 0) & in_category(category))
    return rows if thread < 0 else rows.filter(F.col("tid") == thread)


def event_at(evidence: DataFrame, seq: int) -> DataFrame:
    return evidence.filter(F.col("seq") == seq)


def events_at_sequences(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of a prepared (run_id, seq) list; a listed event that is missing fails the job."""
    rows = wanted.select("run_id", "seq").join(evidence.withColumn("_found", F.lit(True)), ["run_id", "seq"], "left")
    missing = F.raise_error(F.concat(F.lit("Listed event not found: "), F.col("seq").cast("string")))
    return rows.withColumn("seq", F.when(F.col("_found"), F.col("seq")).otherwise(missing.cast("bigint"))).drop("_found")


def loaded_modules(modules: DataFrame) -> DataFrame:
    """The load rows of every run."""
    return modules.filter("loaded")


def restrict_to_main(evidence: DataFrame, instructions: DataFrame, modules: DataFrame) -> DataFrame:
    """Keep events whose instruction lies in the run's main executable."""
    main = modules.filter("is_main").select("run_id", F.col("module_id").alias("mid")).distinct()
    inside = instructions.join(main, ["run_id", "mid"], "left_semi").select("run_id", "iid")
    return evidence.join(inside, ["run_id", "iid"], "left_semi")


def with_instruction(events: DataFrame, instructions: DataFrame) -> DataFrame:
    """Adds routine, disassembly and encoding; instruction 0 or an unknown id gives nulls."""
    wanted = instructions.filter(F.col("iid") != 0).select("run_id", "iid", "routine", "disassembly", "encoding")
    return events.join(wanted, ["run_id", "iid"], "left")


def register_catalog(definitions: DataFrame) -> DataFrame:
    """Newest name per register id."""
    position = F.col("ordinal") if "ordinal" in definitions.columns else F.col("name")
    return (definitions.groupBy("run_id", F.col("register_id").alias("reg"))
            .agg(F.max_by("name", position).alias("register_name")))


def with_register_name(events: DataFrame, registers: DataFrame) -> DataFrame:
    named = events.join(registers.select("run_id", "reg", "register_name"), ["run_id", "reg"], "left")
    fallback = F.concat(F.lit("register #"), F.col("reg").cast("string"))
    return named.withColumn("register_name", F.coalesce("register_name", fallback))


def _dataset_label(kind: int) -> Column:
    return F.lit(schemas.NAMES[kind].replace("_events", "").replace("_", " "))


# The words that event views show for calls, returns and branches.
OUTCOMES = {"call": "call #", "return": "return #", "no call": "unmatched return", "taken": "taken", "passed": "not taken"}


def _outcome(kind: int, have: set[str]) -> Column:
    if kind == 18:
        return X.spaced("reason")
    if kind == 7:
        return F.concat(F.lit(OUTCOMES["call"]), F.col("call_id").cast("string"))
    if kind == 8:
        return F.when(F.col("matched"), F.concat(F.lit(OUTCOMES["return"]), F.col("call_id").cast("string"))
                      ).otherwise(OUTCOMES["no call"])
    if kind == 11:
        return F.when(F.col("taken"), OUTCOMES["taken"]).otherwise(OUTCOMES["passed"])
    parts = [F.col(c) for c in ("access", "event") if c in have]
    if "action" in have:
        parts.append(F.concat(F.lit(" · "), F.col("action")))
    return X.spaced(F.concat(*parts)) if parts else F.lit("")


def event_view(tables: dict[str, DataFrame], instructions: DataFrame, registers: DataFrame) -> DataFrame:
    """Display columns of every dynamic event."""
    views = []
    for name, df in tables.items():
        kind = schemas.KIND_OF[name]
        if "sequence" not in df.columns:
            continue
        df = normalize_enums(df, kind)
        have = set(df.columns)
        if kind == 6:
            storage = F.lit(None).cast("string")  # filled from the register catalog below
        elif kind == 5:
            storage = B.hex_address("memory_address")
        elif "target_address" in have:
            storage = B.hex_address("target_address")
        else:
            storage = F.lit("")
        if kind == 8:
            value = F.concat(F.lit("RAX "), B.hex_address("integer_return_low"))
        elif kind == 7:
            value = F.concat(F.lit("RCX "), B.hex_address("rcx"), F.lit(", RDX "), B.hex_address("rdx"))
        elif kind in (5, 6):
            value = B.hex_text("value_hex")
        else:
            value = F.lit("")
        zero = F.lit(0).cast("bigint")
        views.append(df.select(
            "run_id", F.col("sequence").alias("seq"),
            (F.col("thread_id") if "thread_id" in have else zero).alias("tid"),
            (F.col("instruction_id") if "instruction_id" in have else zero).alias("iid"),
            (F.col("register_id") if kind == 6 else zero).alias("reg"),
            _dataset_label(kind).alias("event"), _outcome(kind, have).alias("outcome"),
            storage.alias("storage"), F.coalesce(value, F.lit("")).alias("captured_value")))
    rows = with_register_name(with_instruction(reduce(DataFrame.unionByName, views), instructions), registers)
    return rows.select(
        "run_id", "seq", "tid", "event", "outcome", F.coalesce("routine", F.lit("")).alias("routine"),
        F.coalesce("disassembly", F.lit("")).alias("instruction"),
        F.coalesce("storage", "register_name").alias("storage"), "captured_value")


def described(df: DataFrame, kind: int) -> Column:
    """``name: value`` lines of a record in schema order, then its derived fields."""
    df = normalize_enums(df, kind)
    shown = []
    for name, stored in schemas.fields(kind):
        c = F.col(name)
        shown.append((name, B.hex_address(c) if stored == "address" else B.hex_text(c) if stored == "bytes" else c.cast("string")))
    for flag, (on, off) in schemas.FLAG_WORDS.items():
        if flag in dict(schemas.fields(kind)):
            shown.append(("event", F.when(F.col(flag), on).otherwise(off)))
    if kind == 5:
        shown.append(("copied_size", F.coalesce(F.length("value_hex"), F.lit(0)).cast("string")))
    return F.concat(*[part for name, value in shown
                      for part in (F.lit(f"{name}: "), F.coalesce(value, F.lit("")), F.lit("\n"))])


def detail_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Key columns plus the described text of every dynamic event."""
    parts = []
    for name, df in tables.items():
        kind = schemas.KIND_OF[name]
        if "sequence" in df.columns:
            rows = normalize_enums(df, kind)
            text = described(df, kind)
            parts.append(_with_text(rows, text, kind))
    return reduce(DataFrame.unionByName, parts)


def _with_text(rows: DataFrame, text: Column, kind: int) -> DataFrame:
    have = set(rows.columns)
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "run_id", F.lit(kind).alias("kind"), F.col("sequence").alias("seq"),
        (F.col("thread_id") if "thread_id" in have else zero).alias("tid"),
        (F.col("instruction_id") if "instruction_id" in have else zero).alias("iid"),
        (F.col("register_id") if kind == 6 else zero).alias("reg"),
        (F.col("access") if kind in (5, 6) else F.lit("")).alias("access"),
        (F.col("memory_address") if kind == 5 else F.lit(0).cast(B.U64)).alias("addr"),
        ((F.col("memory_address") + F.col("requested_size")) if kind == 5
         else F.lit(0)).cast("decimal(21,0)").alias("endaddr"),
        (F.col("value_hex") if kind in (5, 6) else F.lit(None).cast("binary")).alias("captured"),
        text.alias("text"))


def call_channels(calls: DataFrame, returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw argument and return channels, without type inference."""
    arguments = calls.select(
        "run_id", "call_id", F.col("sequence").alias("seq"), F.col("thread_id").alias("tid"),
        F.array("rcx", "rdx", "r8", "r9").alias("integer_arguments"),
        F.array("xmm0", "xmm1", "xmm2", "xmm3").alias("vector_arguments"),
        "stack_pointer", "stack_snapshot")
    results = returns.select(
        "run_id", "call_id", F.col("sequence").alias("seq"), F.col("thread_id").alias("tid"),
        F.col("integer_return_low").alias("rax"), F.col("integer_return_high").alias("rdx"),
        F.array("xmm0", "xmm1").alias("vector_returns"), "st0")
    return arguments, results


def capture_shortfall(memory: DataFrame, run: DataFrame) -> DataFrame:
    """Why a memory sample is shorter than requested, with the diagnostic reason; others are left out."""
    limits = run.filter("started").groupBy("run_id").agg(F.max("max_memory_bytes").alias("max_memory_bytes"))
    intended = F.least("requested", "max_memory_bytes")
    captured = F.coalesce(F.length("captured"), F.lit(0)).cast("bigint")
    reason = (F.when(captured < intended, "memory_unreadable")
              .when(F.col("requested") > intended, "memory_capture_limit"))
    return (memory.filter((F.col("kind") == 5) & (F.col("access") != "prefetch"))
            .join(limits, "run_id")
            .select("run_id", "seq", "tid", "iid", "addr", "requested", captured.alias("captured_size"),
                    reason.alias("reason"))
            .filter(F.col("reason").isNotNull()))


def capture_policy_notices(run: DataFrame) -> DataFrame:
    """Notices implied by a run's settings."""
    # Notice names.
    notices = F.array_compact(F.array(
        F.lit("policy_user_space_observations_exclude_kernel_and_external_memory_writes"),
        F.when(F.col("scope") == "main", "policy_main_scope_excludes_other_images_and_generated_code"),
        F.when(~F.col("registers"), "policy_register_capture_disabled")))
    return run.filter("started").select("run_id", F.explode(notices).alias("reason"))


def parse_storage(watches: DataFrame, text: str = "watch") -> DataFrame:
    """``0xADDRESS[:SIZE]`` or a register name to a typed watch; anything else has kind null."""
    t = F.trim(F.col(text))
    memory = r"^0[xX]\+?([0-9a-fA-F]+)(?::\+?([0-9]+))?$"
    digits = F.ltrim(F.regexp_extract(t, memory, 1), F.lit("0"))
    size_text = F.regexp_extract(t, memory, 2)
    size = F.when(size_text == "", F.lit(8)).when(F.length(F.ltrim(size_text, F.lit("0"))) <= 3, size_text.cast("int"))
    is_memory = t.rlike(memory) & (F.length(digits) <= 16) & size.between(1, 256)
    is_register = t.rlike(r"^[A-Za-z][A-Za-z0-9]*$")
    address = F.when(digits == "", F.lit(0).cast(B.U64)).otherwise(F.conv(digits, 16, 10).cast(B.U64))
    return watches.withColumns({
        "watch_kind": F.when(F.coalesce(is_memory, F.lit(False)), "memory").when(is_register, "register"),
        "address": F.when(F.coalesce(is_memory, F.lit(False)), address),
        "size": F.when(F.coalesce(is_memory, F.lit(False)), size).when(is_register, F.lit(8)),
        "register": F.when(is_register, F.lower(t)),
    })
