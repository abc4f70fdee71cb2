"""Recordings derived from the given tables, so that every operator can run over whole tables.

Each function states in SQL how columns of the given tables stand in for recorded fields. ``DUCK``
holds the same definitions for the oracle (integer division is // there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = ["click", "error", "purchase", "signup", "view"]   # event types stand for five runs


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- events as evidence ------------------------------------------------------------------------------

_KIND = """CASE event_id % 10 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 5 WHEN 5 THEN 6
  WHEN 6 THEN 7 WHEN 7 THEN 8 WHEN 8 THEN 11
  ELSE CASE (event_id {div} 10) % 10 WHEN 0 THEN 13 WHEN 1 THEN 15 WHEN 2 THEN 12 WHEN 3 THEN 18 WHEN 4 THEN 9
       WHEN 5 THEN 17 ELSE 4 END END"""
_ACCESS = """CASE WHEN kind = 5 AND event_id % 10 = 3 THEN CASE WHEN k % 4 = 0 THEN 'read' ELSE 'write_before' END
  WHEN kind = 5 THEN CASE WHEN k % 5 = 0 THEN 'read' WHEN k % 17 = 0 THEN 'prefetch' ELSE 'write_after' END
  WHEN kind = 6 THEN CASE k % 3 WHEN 0 THEN 'read_before' WHEN 1 THEN 'write_before' ELSE 'write_after' END
  ELSE '' END"""
_RUN = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END"

_COLUMNS = """SELECT CAST({run} AS BIGINT) AS run_id, event_id, seq, ns, tid, grp, k, kind,
  CASE WHEN kind = 5 THEN grp % 10 + 1 WHEN kind IN (9, 13, 17) THEN 0 WHEN kind = 4 THEN user_id + 1
       ELSE k % 50 + 1 END AS iid,
  CASE WHEN kind = 5 THEN (grp {div} 1000) * 64 + (grp % 10) * 4 ELSE 0 END AS addr,
  CASE WHEN kind = 5 THEN CASE grp % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END ELSE 0 END AS width,
  {access} AS access,
  CASE WHEN kind = 6 THEN k % 4 + 1 ELSE 0 END AS reg,
  CASE WHEN kind = 7 THEN grp WHEN kind = 8 THEN greatest(grp - k % 3, 0) ELSE 0 END AS cid,
  CASE WHEN kind = 7 THEN k % 5 + 1 ELSE 0 END AS target,
  CASE WHEN kind = 5 THEN substr(h, 1, 2 * CASE grp % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END)
       WHEN kind = 6 THEN substr(h, 1, 16) ELSE '' END AS hex
FROM (SELECT *, {kind} AS kind FROM (
  SELECT event_id, user_id, event_type, event_id + 1 AS seq, {ns} AS ns, (event_id {div} 100) % 8 AS tid,
    event_id {div} 10 + 1 AS grp, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    md5(CAST(event_id % 97 AS {text})) AS h FROM events)) AS e"""


def _columns(run: str, div: str, ns: str, text: str) -> str:
    return _COLUMNS.format(run=run, div=div, ns=ns, text=text, kind=_KIND.format(div=div), access=_ACCESS)


def event_rows(spark: SparkSession, sf: str, runs: bool = False) -> DataFrame:
    """One row per event with all recorded stand-in columns; ``runs``: five runs instead of one."""
    ns = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) * 1000"
    sql = _columns(_RUN if runs else "1", "div", ns, "STRING")
    return spark.sql(sql.replace("FROM events)", "FROM {events})"), events=read(spark, sf, "events"))


def evidence(spark: SparkSession, sf: str, runs: bool = False) -> DataFrame:
    u64 = "DECIMAL(20,0)"
    return event_rows(spark, sf, runs).selectExpr(
        "CAST(run_id AS BIGINT) AS run_id", "kind", "seq", "ns", "tid", "iid", "CAST(0 AS BIGINT) AS mid",
        f"CAST(0 AS {u64}) AS off", f"CAST(addr AS {u64}) AS addr",
        "CAST(addr + width AS DECIMAL(21,0)) AS endaddr", "CAST(0 AS BIGINT) AS operand",
        "CAST(0 AS BIGINT) AS element", "CAST(width AS BIGINT) AS requested", "CAST(reg AS BIGINT) AS reg",
        "access", "cid", f"CAST(target AS {u64}) AS target",
        "CASE WHEN kind IN (5, 6) THEN unhex(hex) END AS captured")


def typed_tables(spark: SparkSession, sf: str, runs: bool = False) -> dict[str, DataFrame]:
    """The dynamic record types as typed tables, from the same rows."""
    ev = event_rows(spark, sf, runs)
    a, n = "DECIMAL(20,0)", "BIGINT"
    head = ["CAST(run_id AS BIGINT) AS run_id", "seq AS sequence", "ns AS monotonic_ns", "tid AS thread_id"]
    code = [*head, "iid AS instruction_id"]

    def of(kind, *columns):
        return ev.filter(f"kind = {kind}").selectExpr(*columns)

    def address(expression, name):
        return f"CAST({expression} AS {a}) AS {name}"

    return {
        "instruction_events": of(4, *code),
        "memory_events": of(5, *code, address("addr", "memory_address"), f"CAST(0 AS {n}) AS operand_index",
                            f"CAST(0 AS {n}) AS element_index", "false AS multi_element",
                            f"CAST(width AS {n}) AS requested_size", "access", "unhex(hex) AS value_hex"),
        "register_events": of(6, *code, f"CAST(reg AS {n}) AS register_id", "access", "unhex(hex) AS value_hex"),
        "call_events": of(7, *code, "cid AS call_id", f"CAST(0 AS {n}) AS target_function_id",
                          address("target", "target_address"), address("4096 + k % 5", "expected_return_address"),
                          address("k", "rcx"), address("seq", "rdx"), address("grp", "r8"), address("tid", "r9"),
                          "X'' AS xmm0", "X'' AS xmm1", "X'' AS xmm2", "X'' AS xmm3",
                          address("1000000 + seq", "stack_pointer"), "X'' AS stack_snapshot",
                          f"CAST(0 AS {n}) AS depth", "true AS direct"),
        "return_events": of(8, *code, "cid AS call_id", address("4096 + k % 7", "target_address"),
                            address("k * 3", "integer_return_low"), address("0", "integer_return_high"),
                            "X'' AS xmm0", "X'' AS xmm1", "X'' AS st0", f"CAST(0 AS {n}) AS depth",
                            "cid > 0 AS matched"),
        "thread_events": of(9, *head, "tid + 100 AS os_thread_id", "k % 2 = 0 AS started"),
        "branch_events": of(11, *code, f"CAST(0 AS {n}) AS target_function_id", address("k", "target_address"),
                            address("k + 1", "fall_through_address"), "k % 2 = 0 AS taken", "true AS direct",
                            "true AS conditional"),
        "syscall_events": of(12, *head, "grp AS syscall_id", address("0", "instruction_pointer"),
                             address("k", "number"), f"CAST(0 AS {n}) AS standard",
                             *[address("0", f"arg{i}") for i in range(16)], address("k", "return_value"),
                             "k % 2 = 0 AS entering"),
        "context_change_events": of(13, *head, f"k % 6 AS reason", "CAST(k - 50 AS INT) AS info",
                                    address("k", "from_instruction_pointer"), address("k", "to_instruction_pointer")),
        "memory_lifecycle_events": of(15, *head, "grp AS operation_id", "k % 3 + 1 AS definition_id",
                                      "CASE k % 2 WHEN 0 THEN 'allocate' ELSE 'free' END AS action",
                                      *[address("k", f"arg{i}") for i in range(12)], address("k", "result"),
                                      address("k", "base_address"), address("0", "previous_address"),
                                      address("k", "size"), address("4", "protection"), "k > 0 AS succeeded",
                                      "k % 2 = 0 AS entering", "true AS matched"),
        "process_events": of(17, "CAST(run_id AS BIGINT) AS run_id", "seq AS sequence", "ns AS monotonic_ns",
                             "grp AS process_id", "grp AS parent_process_id", "k AS related_process_id",
                             "CASE k % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'child' ELSE 'finish' END AS event",
                             "true AS follow_children_enabled", "true AS followed", "CAST(k AS INT) AS exit_code",
                             "'out' AS output_directory", "'app' AS command_line"),
        "capture_diagnostics": of(18, *code, address("k", "address"), "k AS requested",
                                  f"CAST(0 AS {n}) AS captured", f"{_REASON} AS reason"),
    }


_REASON = ("CASE k % 4 WHEN 0 THEN 'memory_unreadable' WHEN 1 THEN 'memory_capture_limit' "
           "WHEN 2 THEN 'write_after_without_before' ELSE 'missing_thread_state' END")


def registers(spark: SparkSession, sf: str, runs: bool = False) -> DataFrame:
    """Register definitions of every run that has events (three of the four ids the events use)."""
    ids = event_rows(spark, sf, runs).filter("kind = 6 AND reg < 4").select("run_id", "reg").distinct()
    return ids.selectExpr("CAST(run_id AS BIGINT) AS run_id", "CAST(reg AS BIGINT) AS register_id",
                          "element_at(array('rax', 'rbx', 'rcx'), CAST(reg AS INT)) AS name")


def instructions(spark: SparkSession, sf: str, runs: int = 1) -> DataFrame:
    """The part table as instruction dictionary; two parts share an offset (code revisions)."""
    return read(spark, sf, "part").selectExpr(
        f"explode(sequence(1L, {runs}L)) AS run_id", "p_partkey + 1 AS iid",
        "((p_partkey + 1) div 2) % 3 + 1 AS mid", "CAST(((p_partkey + 1) div 2) * 16 AS DECIMAL(20,0)) AS off",
        "CAST(1048576 + (p_partkey + 1) * 16 AS DECIMAL(20,0)) AS address", "p_brand AS routine",
        "p_name AS disassembly", "unhex(substr(md5(p_name), 1, 8)) AS encoding")


def document_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts as memory writes, in the evidence layout."""
    return read(spark, sf, "documents").selectExpr(
        "CAST(1 AS BIGINT) AS run_id", "5 AS kind", "doc_id + 1 AS seq", "doc_id AS ns", "doc_id % 8 AS tid",
        "doc_id % 50 + 1 AS iid", "CAST(0 AS BIGINT) AS mid", "CAST(0 AS DECIMAL(20,0)) AS off",
        "CAST((doc_id % 50) * 256 AS DECIMAL(20,0)) AS addr",
        "CAST((doc_id % 50) * 256 + octet_length(text) AS DECIMAL(21,0)) AS endaddr",
        "CAST(0 AS BIGINT) AS operand", "CAST(0 AS BIGINT) AS element",
        "CAST(octet_length(text) AS BIGINT) AS requested", "CAST(0 AS BIGINT) AS reg",
        "'write_after' AS access", "CAST(0 AS BIGINT) AS cid", "CAST(0 AS DECIMAL(20,0)) AS target",
        "CAST(text AS BINARY) AS captured")


# --- other tables ------------------------------------------------------------------------------------

_MODULES = """SELECT {runs} AS run_id, s_suppkey + 1 AS module_id, s_name, s_nationkey,
  CAST(s_suppkey AS BIGINT) {div} 2 * 2097152 AS base, 65536 * (1 + s_nationkey) AS size,
  1 + (s_suppkey % 2) * 7500 AS load_seq,
  CASE WHEN s_suppkey % 2 = 0 THEN 7001 END AS unload_seq FROM {supplier}"""


def modules(spark: SparkSession, sf: str, runs: int = 1) -> DataFrame:
    """Suppliers as images: pairs share a base one after the other; run 5 has another build of each,
    run 4 has a second copy of the images of suppliers in debt."""
    base = spark.sql(_MODULES.format(runs=f"explode(sequence(1L, {runs}L))", div="div", supplier="{supplier}"),
                     supplier=read(spark, sf, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("bigint")))
    u64 = "DECIMAL(20,0)"
    copies = (read(spark, sf, "supplier").filter(F.lit(runs >= 4) & (F.col("s_acctbal") < 0))
              .selectExpr("s_suppkey + 1 AS module_id"))
    again = (base.filter("run_id = 4").join(copies, "module_id", "left_semi")
             .withColumn("module_id", F.col("module_id") + 1000000))
    both = base.unionByName(again.select(*base.columns))
    return both.selectExpr(
        "run_id", "explode(CASE WHEN unload_seq IS NULL THEN array(true) ELSE array(true, false) END) AS loaded",
        "module_id", "load_seq", "unload_seq",
        "CASE WHEN run_id = 2 THEN concat('D:/apps/', upper(s_name), '.DLL') "
        "ELSE concat('C:\\\\apps\\\\', s_name, '.dll') END AS path",
        f"CAST(base AS {u64}) AS base", f"CAST(base + size - 1 AS {u64}) AS high",
        f"CAST(0 AS {u64}) AS load_offset", f"CAST(base + 4096 AS {u64}) AS entry_address",
        f"CAST(size AS {u64}) AS mapped_size", "CAST(1 AS BIGINT) AS image_type",
        "s_nationkey <> 3 AS pe_identity_valid", "CAST(34404 AS BIGINT) AS machine",
        "1700000000 + s_nationkey + CASE WHEN run_id = 5 THEN 1 ELSE 0 END AS pe_timestamp",
        "CAST(s_nationkey * 7 AS BIGINT) AS pe_checksum", "size AS declared_image_size",
        "CAST(4096 AS BIGINT) AS entry_point_rva", "module_id = 1 AS is_main"
    ).withColumn("sequence", F.expr("CASE WHEN loaded THEN load_seq ELSE unload_seq END")
                 ).withColumn("monotonic_ns", F.col("sequence") * 1000).drop("load_seq", "unload_seq")


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a run: settings from its columns, a finish row for finished ones."""
    return read(spark, sf, "orders").selectExpr(
        "o_orderkey + 1 AS run_id",
        "explode(CASE o_orderstatus WHEN 'F' THEN array(true, false) ELSE array(true) END) AS started",
        "CAST(20 AS BIGINT) AS format_version", "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS unix_timestamp",
        "o_orderkey AS monotonic_ns", "CAST(8 AS BIGINT) AS pointer_size",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'main' ELSE 'all' END AS scope",
        "CAST(4 AS BIGINT) AS max_memory_bytes", "CAST(64 AS BIGINT) AS call_stack_bytes",
        "o_totalprice < 250000 AS registers")


def processes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as processes: key n + 1 has parent (n + 1) div 2; start, child and finish rows."""
    return read(spark, sf, "customer").selectExpr(
        "explode(array('start', 'child', 'finish')) AS event", "c_custkey + 1 AS _n", "c_mktsegment", "c_name",
        "c_nationkey", "c_acctbal").selectExpr(
        "1L AS run_id", "3 * _n + CASE event WHEN 'child' THEN 0 WHEN 'start' THEN 1 ELSE 2 END AS sequence", "event", "CASE event WHEN 'child' THEN _n div 2 ELSE _n END AS process_id",
        "_n div 2 AS parent_process_id", "CASE event WHEN 'child' THEN _n ELSE 0 END AS related_process_id",
        "event = 'child' AND c_acctbal > 0 AS followed", "CAST(c_nationkey AS INT) AS exit_code",
        "c_mktsegment AS output_directory", "CASE event WHEN 'finish' THEN '' ELSE c_name END AS command_line",
        "_n AS _n").filter("NOT (event = 'child' AND _n = 1)").drop("_n")


def reused_processes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as process starts in order of their keys; 700 ids are used again and again."""
    return read(spark, sf, "customer").selectExpr(
        "1L AS run_id", "c_custkey + 1 AS sequence", "'start' AS event", "c_custkey % 700 + 1 AS process_id",
        "c_custkey div 2 % 700 + 1 AS parent_process_id", "0L AS related_process_id", "false AS followed", "CAST(0 AS INT) AS exit_code",
        "'' AS output_directory", "'' AS command_line")


# --- the same definitions for the oracle ---------------------------------------------------------------

def _duck_events(run: str) -> str:
    return _columns(run, "//", "epoch_us(ts) * 1000", "VARCHAR")


DUCK = {
    "ev": f"ev AS MATERIALIZED ({_duck_events('1')})",
    "evr": f"evr AS MATERIALIZED ({_duck_events(_RUN)})",
    "ins": """ins AS (SELECT p_partkey + 1 AS iid, ((p_partkey + 1) // 2) % 3 + 1 AS mid,
  ((p_partkey + 1) // 2) * 16 AS off, p_brand AS routine, p_name AS disassembly,
  substr(md5(p_name), 1, 8) AS encoding FROM part)""",
    "docs": """docs AS (SELECT doc_id + 1 AS seq, doc_id % 8 AS tid, doc_id % 50 + 1 AS iid,
  (doc_id % 50) * 256 AS addr, text, lower(hex(encode(text))) AS hex FROM documents)""",
    "mods": """mods AS (SELECT s_suppkey + 1 AS module_id, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal,
  (s_suppkey // 2) * 2097152 AS base, 65536 * (1 + CAST(s_nationkey AS BIGINT)) AS size, 1 + (s_suppkey % 2) * 7500 AS load_seq,
  CASE WHEN s_suppkey % 2 = 0 THEN 7001 END AS unload_seq FROM supplier)""",
    "runs": "runs AS (SELECT DISTINCT run_id FROM evr)",
}


def duck(*names: str, recursive: bool = False) -> str:
    """WITH clause with the named definitions."""
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(DUCK[n] for n in names)


def all_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """One complete recording: all eighteen record types as typed tables."""
    u64 = "DECIMAL(20,0)"
    part = read(spark, sf, "part")
    first = read(spark, sf, "events").selectExpr(
        "min(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)) AS unix_timestamp")
    static = {
        "run": first.selectExpr(
            "1L AS run_id", "20L AS format_version", "CAST(unix_timestamp AS BIGINT) AS unix_timestamp",
            "0L AS monotonic_ns", "8L AS pointer_size", "'all' AS scope", "64L AS max_memory_bytes",
            "64L AS call_stack_bytes", "true AS registers", "explode(array(true, false)) AS started"),
        "modules": modules(spark, sf).withColumn("sequence", F.expr("1000000000 + module_id * 2 + CAST(loaded AS INT)")),
        "instruction_definitions": instructions(spark, sf).selectExpr(
            "run_id", "iid AS instruction_id", "mid AS module_id", "address", "off AS module_offset", "4L AS size",
            "encoding AS encoding_hex", "routine", "concat(disassembly, ', \"', routine, '\"\\n;') AS disassembly"),
        "register_definitions": registers(spark, sf).withColumn("size", F.lit(8).cast("bigint")),
        "memory_api_definitions": part.selectExpr(
            "1L AS run_id", "p_partkey + 1 AS definition_id", "p_partkey % 3 + 1 AS module_id",
            f"CAST(p_partkey * 16 AS {u64}) AS address", "CAST(p_size % 19 AS BIGINT) AS kind", "p_name AS name"),
        "function_definitions": part.selectExpr(
            "1L AS run_id", "p_partkey + 1 AS function_id", "p_partkey % 3 + 1 AS module_id",
            f"CAST(p_partkey * 64 AS {u64}) AS address", f"CAST(p_partkey * 64 AS {u64}) AS module_offset",
            f"CAST(p_size AS {u64}) AS size", "p_name AS name"),
    }
    return {**static, **typed_tables(spark, sf)}
