"""Modules, code identities, address attribution and process trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import bytes as B
from spoor.operators import ordered
from spoor.operators.coverage import IDENTITY
from spoor.session import scratch_path


def module_lifetimes(modules: DataFrame) -> DataFrame:
    """Load rows with the unload of the same module id; unloads of unknown images (id 0) stay alone."""
    known = modules.filter("module_id <> 0")
    first = F.struct("path", "base", "high", "mapped_size", "is_main")
    spans = (known.groupBy("run_id", "module_id")
             .agg(F.min(F.when(F.col("loaded"), F.col("sequence"))).alias("load_seq"),
                  F.min(F.when(~F.col("loaded"), F.col("sequence"))).alias("unload_seq"),
                  F.min_by(first, F.struct(~F.col("loaded"), F.col("sequence"))).alias("_m")))
    spans = spans.select("run_id", "module_id", "load_seq", "unload_seq", "_m.*")
    alone = modules.filter("module_id = 0 AND NOT loaded").select(
        "run_id", "module_id", F.lit(None).cast("bigint").alias("load_seq"), F.col("sequence").alias("unload_seq"),
        "path", "base", "high", "mapped_size", "is_main")
    return spans.unionByName(alone)


def rva_map(points: DataFrame, modules: DataFrame) -> DataFrame:
    """Program addresses to runtime addresses: (run_id, module_id, address, image_base).

    runtime = base + (address - image_base) when that offset lies inside the module, else null.
    """
    offset = B.wrap_unsigned(F.col("address").cast("decimal(22,0)") - F.col("image_base").cast("decimal(22,0)"))
    joined = points.join(modules.filter("loaded").select("run_id", "module_id", "base", "mapped_size"),
                         ["run_id", "module_id"], "left")
    runtime = B.wrap_unsigned(F.col("base").cast("decimal(22,0)") + F.col("_offset").cast("decimal(22,0)"))
    return (joined.withColumn("_offset", offset)
            .withColumn("runtime", F.when(F.col("_offset") < F.col("mapped_size"), runtime))
            .drop("_offset", "base", "mapped_size"))


def program_map(instructions: DataFrame, programs: DataFrame) -> DataFrame:
    """Recorded instructions to program addresses, for programs (run_id, module_id, image_base)."""
    shown = programs.select("run_id", F.col("module_id").alias("mid"), "image_base")
    address = B.wrap_unsigned(F.col("image_base").cast("decimal(22,0)") + F.col("off").cast("decimal(22,0)"))
    return instructions.join(shown, ["run_id", "mid"]).withColumn("program_address", address)


def _pe_u(content: Column, at: Column, width: int) -> Column:
    raw = F.substring(content, (at + 1).cast("int"), F.lit(width))
    return F.when(F.length(raw) == width, B.little_unsigned(raw).cast("bigint"))


def pe_identities(files: DataFrame, content: str = "content") -> DataFrame:
    """Header identity of executable images in a binary column; invalid images are flagged, not errors."""
    c = F.col(content)
    pe = _pe_u(c, F.lit(0x3c), 4)
    step = files.withColumn("_pe", F.when((_pe_u(c, F.lit(0), 2) == 0x5a4d) & (pe < (1 << 31) - 256), pe))
    at = F.col("_pe")
    optional = at + 24
    fields = {
        "machine": _pe_u(c, at + 4, 2), "pe_timestamp": _pe_u(c, at + 8, 4),
        "entry_point_rva": _pe_u(c, optional + 16, 4), "declared_image_size": _pe_u(c, optional + 56, 4),
        "pe_checksum": _pe_u(c, optional + 64, 4)}
    complete = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in fields])
    valid = (at.isNotNull() & (_pe_u(c, at, 4) == 0x4550) & (_pe_u(c, at + 20, 2) >= 68)
             & _pe_u(c, optional, 2).isin(0x10b, 0x20b) & complete)
    step = step.withColumns(fields).withColumn("pe_identity_valid", F.coalesce(valid, F.lit(False)))
    return step.withColumns({n: F.when(F.col("pe_identity_valid"), F.col(n)).otherwise(F.lit(0).cast("bigint"))
                             for n in fields}).drop("_pe")


def module_identity_problem(modules: DataFrame, programs: DataFrame) -> DataFrame:
    """What keeps a program's headers from fitting a recorded module, as a short code; null if they fit.

    ``programs``: (run_id, module_id, content) with the header bytes of the program; ``pointer_size``
    and ``big_endian`` columns are optional. The codes: ``not_recorded`` (the recording holds no identity),
    ``platform`` (not 64-bit little endian), ``unreadable`` (the header bytes end too early), ``no_image``,
    ``header_offset``, ``no_signature``, ``not_64_bit``, or the name of the first identity field that differs.
    """
    content, at = F.col("content"), F.col("_header")
    given = set(programs.columns)
    platform = [F.col("big_endian")] if "big_endian" in given else []
    platform += [F.col("pointer_size") != 8] if "pointer_size" in given else []
    # field: offset from the header, width, recorded column or fixed value (the layout of PE headers)
    fields = {"no_signature": (0, 4, F.lit(0x4550)), "machine": (4, 2, F.col("machine")),
              "pe_timestamp": (8, 4, F.col("pe_timestamp")), "not_64_bit": (24, 2, F.lit(0x20b)),
              "entry_point_rva": (40, 4, F.col("entry_point_rva")),
              "declared_image_size": (80, 4, F.col("declared_image_size")), "pe_checksum": (88, 4, F.col("pe_checksum"))}
    headers = programs.withColumns({
        "_start": _pe_u(content, F.lit(0), 2), "_header": _pe_u(content, F.lit(0x3c), 4),
        "_foreign": reduce(Column.__or__, platform, F.lit(False))})
    headers = headers.select("run_id", "module_id", "_start", "_header", "_foreign", *[
        F.when(at <= 0x100000, _pe_u(content, at + offset, width)).alias(f"_{name}") for name, (offset, width, _) in fields.items()])
    steps = [F.when(~F.col("pe_identity_valid"), "not_recorded"), F.when(F.col("_foreign"), "platform"),
             F.when(F.col("_start").isNull(), "unreadable").when(F.col("_start") != 0x5a4d, "no_image"),
             F.when(at.isNull(), "unreadable").when(at > 0x100000, "header_offset")]
    steps += [F.when(F.col(f"_{name}").isNull(), "unreadable").when(F.col(f"_{name}") != wanted, name)
              for name, (_, _, wanted) in fields.items()]
    recorded = modules.filter("loaded").select("run_id", "module_id", "pe_identity_valid", *IDENTITY)
    return recorded.join(headers, ["run_id", "module_id"]).select("run_id", "module_id", F.coalesce(*steps).alias("problem"))


def attribute_function(events: DataFrame, functions: DataFrame, address: str = "target",
                       segment: int | None = None) -> DataFrame:
    """Adds function_id: the newest definition with exactly this entry address, 0 if none.

    ``functions``: (run_id, address, function_id, seq of the defining module load).
    """
    names = [c for c in events.columns if c not in ("run_id", "seq")]
    payload = F.struct(*[F.col(c) for c in names])
    marks = functions.select("run_id", F.col("address").cast(B.U64).alias("_at"), "seq",
                             F.col("function_id").alias("_fid"))
    rows = events.select("run_id", F.col(address).cast(B.U64).alias("_at"), "seq",
                         F.lit(0).cast("bigint").alias("_fid"), payload.alias("_row"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # Definitions of the same load are ordered by id; they come before events of the same sequence.
    both = both.withColumn("_tie", F.when(F.col("_row").isNull(), F.col("_fid")).otherwise(F.lit(ordered.LAST)))
    both = ordered.carry_last(both, ["run_id", "_at"], F.col("_row").isNull(), F.struct("_fid"), "_found",
                              tie=("_tie",), segment=segment)
    return (both.filter(F.col("_row").isNotNull())
            .select("run_id", "seq", "_row.*", F.coalesce("_found._fid", F.lit(0)).alias("function_id")))


_CELLS = 16                             # cells of an image along each axis, at most
_SIZES = tuple(range(16, 64, 4))        # page sizes 2^16 .. 2^60 bytes
_TIMES = tuple(range(4, 52, 4))         # time pieces of 2^4 .. 2^48 sequence numbers


def attribute_module(events: DataFrame, lifetimes: DataFrame, address: str = "addr") -> DataFrame:
    """Adds module_id and module_offset of the image mapped at the address at that moment.

    No image: id 0 and the address itself. The plane of address and time is cut into cells, and an image is listed under
    those it touches, with the smallest page size and time piece that need few of them. An event looks at the one cell of
    its address and moment, once for each pair of sizes that occurs. A cell lists what is mapped near one place at about
    one time, however often an image is loaded again; events are neither multiplied nor numbered nor joined with themselves.
    """
    images = lifetimes.filter("load_seq IS NOT NULL").select(
        "run_id", "load_seq", F.coalesce("unload_seq", F.lit(ordered.LAST)).alias("until"), "base", "high", F.col("module_id").alias("mid"))
    page = lambda c, n: F.expr(f"CAST({c} div CAST({1 << n} AS DECIMAL(20,0)) AS BIGINT)")
    piece = lambda c, n: F.expr(f"shiftright({c}, {n})")

    def smallest(cut, low: str, high: str, sizes: tuple[int, ...]):
        return F.coalesce(*[F.when(cut(high, n) - cut(low, n) < _CELLS, n) for n in sizes], F.lit(sizes[-1]))

    images = images.withColumns({"_size": smallest(page, "base", "high", _SIZES), "_time": smallest(piece, "load_seq", "until", _TIMES)})
    one = F.struct("load_seq", "until", F.col("base").cast(B.U64).alias("base"), F.col("high").cast(B.U64).alias("high"), "mid")
    rows, found = events, F.array().cast("array<struct<load_seq:bigint,until:bigint,base:decimal(20,0),high:decimal(20,0),mid:bigint>>")
    pairs = sorted(tuple(r) for r in images.select("_size", "_time").distinct().collect())   # at most one a pair of sizes
    for n, t in pairs:
        cells = images.filter((F.col("_size") == n) & (F.col("_time") == t))
        cells = cells.withColumn("_page", F.explode(F.sequence(page("base", n), page("high", n))))
        cells = cells.withColumn("_piece", F.explode(F.sequence(piece("load_seq", t), piece("until", t))))
        listed = cells.groupBy("run_id", "_page", "_piece").agg(F.collect_list(one).alias(f"_at{n}_{t}"))
        rows = rows.withColumns({"_page": page(address, n), "_piece": piece("seq", t)}).join(
            listed, ["run_id", "_page", "_piece"], "left").drop("_page", "_piece")
        found = F.concat(found, F.coalesce(f"_at{n}_{t}", F.array().cast(listed.schema[f"_at{n}_{t}"].dataType)))
    mapped = lambda x: ((F.col(address) >= x["base"]) & (F.col(address) <= x["high"])
                        & (F.col("seq") >= x["load_seq"]) & (F.col("seq") < x["until"]))
    rows = rows.withColumn("_hit", F.array_max(F.filter(found, mapped)))               # the newest load
    return rows.withColumns({
        "module_id": F.coalesce("_hit.mid", F.lit(0).cast("bigint")),
        "module_offset": F.when(F.col("_hit").isNull(), F.col(address)).otherwise(
            F.col(address) - F.col("_hit.base")).cast(B.U64)}).select(*events.columns, "module_id", "module_offset")


def code_identity(definitions: DataFrame, segment: int | None = None, *, order: str = "seq", tie: tuple = (),
                  ordinal: str | None = None) -> DataFrame:
    """Instruction ids for definition requests (run_id, seq, address, module_id, size, encoding).

    Arrival with another module, size or encoding than the address currently has makes a new id (also
    when it returns to older code); ids count up from 1 in order of arrival. Requests without numbers are put in
    order by ``order`` and ``tie``; ``ordinal`` adds their 0-based positions.
    """
    return ordered.number_changes(definitions, ["run_id"], "address", ["module_id", "size", "encoding"], "created",
                                  "instruction_id", ordinal, order=order, tie=tie, segment=segment)


def process_edges(processes: DataFrame) -> DataFrame:
    """Every process of every run with its parent, whether it was followed, its exit code, output and command line.

    Process ids are used again: each start opens a new life (``life`` = its sequence number) that child
    and finish records up to the next start belong to; records before the first start have life 0. A
    parent is the life of the parent id that was current when the process started, else 0.
    """
    # Child records speak of the new process, the others of their own.
    spoken = F.when(F.col("event") == "child", F.col("related_process_id")).otherwise(F.col("process_id"))
    rows = processes.select("run_id", F.col("sequence").alias("seq"), "event", spoken.alias("process_id"),
                            F.when(F.col("event") == "child", F.col("process_id")).otherwise(F.col("parent_process_id")).alias("_parent"),
                            "followed", "exit_code", "output_directory", "command_line")
    key = ["run_id", "process_id"]
    rows = ordered.carry_last(rows, key, F.col("event") == "start", None, "life", inclusive=True)
    # A parent announces its child just before the child's own start: a leading announcement joins that start.
    ahead = ordered.carry_last(rows.withColumn("_mirror", F.lit(ordered.LAST) - F.col("seq")), key, F.col("event") == "start", None,
                               "_next", order="_mirror").withColumn("_next", F.lit(ordered.LAST) - F.col("_next")).drop("_mirror")
    announces = (F.col("event") == "child") & F.col("_next").isNotNull()
    rows = ahead.withColumn("life", F.coalesce(F.when(announces, F.col("_next")), "life", F.lit(0).cast("bigint")))
    is_ = lambda e: F.col("event") == e
    told = F.struct("_parent", "followed", "output_directory", "command_line")
    lives = rows.groupBy(*key, "life").agg(
        F.max_by(told, F.when(is_("start"), F.col("seq"))).alias("_s"),
        F.max_by(told, F.when(is_("child"), F.struct("followed", "_parent"))).alias("_c"),
        F.max(F.when(is_("finish"), F.col("exit_code"))).alias("exit_code"))
    return lives.filter("_s IS NOT NULL OR _c IS NOT NULL").select(
        *key, "life", F.coalesce("_s._parent", "_c._parent").alias("parent_process_id"), F.col("_s").isNotNull().alias("recorded"),
        F.coalesce("_c.followed", F.lit(False)).alias("followed"), "exit_code",
        F.coalesce("_s.output_directory", "_c.output_directory").alias("output_directory"),
        F.coalesce("_s.command_line", "_c.command_line").alias("command_line"))


def process_tree(edges: DataFrame) -> DataFrame:
    """Root, depth and whether its ancestors form a cycle, of every life of a process.

    Every round doubles the known distance to an ancestor, so the rounds grow with the logarithm of the
    deepest chain. What has not met a root after as many rounds as the number of lives needs is in, or
    below, a cycle; its root is then the smallest process id met. Every round is checkpointed in the
    shared folder and read as a new frame, so plans and estimates stay small and a lost executor costs
    one round.
    """
    spark, key = edges.sparkSession, ["run_id", "process_id", "life"]
    lives = edges.select(*key).distinct()
    asks = edges.select("run_id", F.col("process_id").alias("_child"), F.col("life").alias("seq"), F.col("parent_process_id").alias("process_id"))
    marks = lives.select("run_id", F.lit(None).cast("bigint").alias("_child"), F.col("life").alias("seq"), "process_id")
    # The parent's life is the newest one that began before the child's (or the same unstarted one).
    both = asks.unionByName(marks).withColumn("_tie", F.col("_child").isNotNull().cast("int"))
    found = ordered.carry_last(both, ["run_id", "process_id"], F.col("_child").isNull(), None, "_life", tie=("_tie",))
    parents = found.filter("_child IS NOT NULL").select(
        "run_id", F.col("_child").alias("process_id"), F.col("seq").alias("life"), F.col("process_id").alias("up"), F.col("_life").alias("up_life"))
    inside = F.col("up_life").isNotNull() & (F.col("up") != F.col("process_id"))
    state = parents.select(*key, F.when(inside, F.col("up")).otherwise(F.col("process_id")).alias("root"),
                           F.when(inside, F.col("up_life")).otherwise(F.col("life")).alias("root_life"),
                           inside.cast("bigint").alias("depth"), inside.alias("open"), F.least("process_id", "up").alias("least"))
    state = _fresh(spark, state)
    rounds = max(1, int(state.count()).bit_length() + 1)
    for _ in range(rounds):
        if not state.filter("open").limit(1).count():
            break
        above = state.select("run_id", F.col("process_id").alias("root"), F.col("life").alias("root_life"), F.col("root").alias("_root"),
                             F.col("root_life").alias("_root_life"), F.col("depth").alias("_more"), F.col("open").alias("_open"),
                             F.col("least").alias("_least"))
        state = _fresh(spark, state.join(above, ["run_id", "root", "root_life"]).select(
            *key, F.col("_root").alias("root"), F.col("_root_life").alias("root_life"),
            F.when(F.col("open"), F.col("depth") + F.col("_more")).otherwise(F.col("depth")).alias("depth"),
            (F.col("open") & F.col("_open")).alias("open"), F.least("least", "_least").alias("least")))
    cycle = F.col("open")
    return edges.join(state.select(*key, F.when(cycle, F.col("least")).otherwise(F.col("root")).alias("root"),
                                   F.when(~cycle, F.col("depth")).alias("depth"), cycle.alias("cycle")), key)


def _fresh(spark, df: DataFrame) -> DataFrame:
    """The rows as a frame that knows nothing of how they came about."""
    path = scratch_path(spark, "process-tree")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
