"""Queries: evidence, counts, timeline, audits."""

from pyspark.sql import functions as F

from spoor import schemas
from spoor.functions import bytes as B
from spoor.operators import audit, coverage, evidence, timeline
from spoor.plans import tables as t
from spoor.plans.registry import big, query
from spoor.plans.tables import duck

_EVIDENCE = ["run_id", "kind", "seq", "ns", "tid", "iid", "addr", "endaddr", "requested", "reg", "access", "cid",
             "target", "captured_hex"]
_EV_SQL = """SELECT CAST(run_id AS BIGINT) run_id, kind, seq, ns, {tid} tid, {iid} iid, addr, addr + width AS endaddr,
  CAST(width AS BIGINT) requested, CAST(reg AS BIGINT) reg, access, cid, {target} AS target,
  hex AS captured_hex FROM ev"""


def shown(df):
    df = df.withColumn("captured_hex", F.coalesce(B.hex_text("captured"), F.lit("")))
    return big(df, "addr", "endaddr", "target").select(*_EVIDENCE)


EVIDENCE_SQL = (duck("ev") + _EV_SQL.format(
    tid="CASE kind WHEN 17 THEN 0 ELSE tid END", iid="CASE WHEN kind IN (12, 15) THEN 0 ELSE iid END",
    target="CASE kind WHEN 8 THEN 4096 + k % 7 WHEN 11 THEN k ELSE target END").replace(
        "addr, addr + width", "CASE kind WHEN 18 THEN k ELSE addr END addr, CASE kind WHEN 18 THEN k ELSE addr + width END"))


@query("to_evidence", EVIDENCE_SQL)
def to_evidence(spark, sf):
    return shown(evidence.to_evidence(t.typed_tables(spark, sf)))


@query("ingest_rejects", duck("ev") + """, bad AS (SELECT seq - k % 3 * seq AS seq, kind, k, hex,
    CASE WHEN k % 7 = 0 THEN width - 1 ELSE width END AS width, CASE WHEN k % 11 = 0 THEN 'execute' ELSE access END access
    FROM ev)
  SELECT seq, kind, concat_ws(',', CASE WHEN seq < 0 OR seq = 0 THEN 'invalid_sequence' END,
    CASE WHEN kind = 5 AND width < length(hex) // 2 THEN 'invalid_memory_width' END,
    CASE WHEN kind IN (5, 6) AND access NOT IN ('read', 'read_before', 'write_before', 'write_after', 'prefetch')
         THEN 'invalid_access' END) AS problems FROM bad
  WHERE seq <= 0 OR (kind = 5 AND width < length(hex) // 2) OR (kind IN (5, 6) AND access = 'execute')""")
def ingest_rejects(spark, sf):
    rows = t.event_rows(spark, sf).selectExpr(
        "seq - k % 3 * seq AS seq", "kind", "unhex(hex) AS captured",
        "CAST(CASE WHEN k % 7 = 0 THEN width - 1 ELSE width END AS BIGINT) AS requested",
        "CASE WHEN k % 11 = 0 THEN 'execute' ELSE access END AS access")
    return evidence.ingest_rejects(rows).select("seq", "kind", F.array_join("problems", ",").alias("problems"))


@query("normalize_enums", duck("ev") + """ SELECT seq, access, 'memory' AS dataset, CAST(length(hex) // 2 AS BIGINT)
  AS copied_size FROM ev WHERE kind = 5 UNION ALL SELECT seq, access, 'register', 0 FROM ev WHERE kind = 6
  UNION ALL SELECT seq, CASE WHEN k % 2 = 0 THEN 'enter' ELSE 'exit' END, 'syscall', 0 FROM ev WHERE kind = 12
  UNION ALL SELECT seq, CASE k % 2 WHEN 0 THEN 'allocate' ELSE 'free' END, 'memory api', 0 FROM ev WHERE kind = 15
  UNION ALL SELECT seq, CASE k % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'child' ELSE 'finish' END, 'process', 0 FROM ev WHERE kind = 17""")
def normalize_enums(spark, sf):
    """All four enumerations as stored numbers, and the word of a flag."""
    tables = t.typed_tables(spark, sf)

    def numbered(name, kind, field="access"):
        words = F.array(*[F.lit(w) for w in schemas.ENUMS[(kind, field)]])
        number = F.array_position(words, F.col(field)).cast("bigint") - 1
        return evidence.normalize_enums(tables[name].withColumn(field, number), kind)

    zero = F.lit(0).cast("bigint").alias("copied_size")
    memory = numbered("memory_events", 5).select(
        F.col("sequence").alias("seq"), "access", F.lit("memory").alias("dataset"), "copied_size")
    register = numbered("register_events", 6).select("sequence", "access", F.lit("register"), zero)
    syscalls = evidence.normalize_enums(tables["syscall_events"], 12).select(
        "sequence", "event", F.lit("syscall"), zero)
    lifecycle = numbered("memory_lifecycle_events", 15, "action").select("sequence", "action", F.lit("memory api"), zero)
    processes = numbered("process_events", 17, "event").select("sequence", "event", F.lit("process"), zero)
    return memory.union(register).union(syscalls).union(lifecycle).union(processes)


_CATEGORY = """CASE category WHEN 'All events' THEN true
  WHEN 'Writes' THEN kind IN (5, 6) AND access = 'write_after' WHEN 'Calls / returns' THEN kind IN (7, 8)
  WHEN 'Control flow' THEN kind IN (7, 8, 11, 13) WHEN 'Memory lifetime' THEN kind = 15
  WHEN 'System / process' THEN kind IN (9, 12, 13, 17) ELSE kind = 18 END"""
_CATEGORIES = "cats(category) AS (VALUES " + ", ".join(f"('{c}')" for c in schemas.CATEGORIES) + ")"


@query("categorize", duck("ev") + f", {_CATEGORIES} SELECT seq, kind, category FROM ev, cats WHERE {_CATEGORY}")
def categorize(spark, sf):
    return evidence.categorize(t.evidence(spark, sf)).select("seq", "kind", "category")


@query("timeline_filter", duck("ev") + """ SELECT seq, kind, tid FROM ev
  WHERE kind IN (7, 8, 11, 13) AND tid = 3""")
def timeline_filter(spark, sf):
    return evidence.timeline_filter(t.evidence(spark, sf), "Control flow", 3).select("seq", "kind", "tid")


_HX = "'0x' || lower(printf('%x', CAST({} AS BIGINT)))"


@query("event_view", duck("ev", "ins") + f""" SELECT e.seq, e.tid_shown AS tid, event, outcome,
  coalesce(i.routine, '') AS routine, coalesce(i.disassembly, '') AS instruction, storage, captured_value
FROM (SELECT seq, CASE WHEN kind = 17 THEN 0 ELSE tid END AS tid_shown,
  CASE WHEN kind IN (9, 12, 13, 15, 17) THEN 0 ELSE iid END AS iid,
  CASE kind WHEN 4 THEN 'instruction' WHEN 5 THEN 'memory' WHEN 6 THEN 'register' WHEN 7 THEN 'call'
    WHEN 8 THEN 'return' WHEN 9 THEN 'thread' WHEN 11 THEN 'branch' WHEN 12 THEN 'syscall'
    WHEN 13 THEN 'context change' WHEN 15 THEN 'memory lifecycle' WHEN 17 THEN 'process'
    ELSE 'capture diagnostics' END AS event,
  CASE kind WHEN 4 THEN '' WHEN 5 THEN replace(access, '_', ' ') WHEN 6 THEN replace(access, '_', ' ')
    WHEN 7 THEN 'call #' || cid WHEN 8 THEN CASE WHEN cid > 0 THEN 'return #' || cid ELSE 'unmatched return' END
    WHEN 9 THEN CASE k % 2 WHEN 0 THEN 'start' ELSE 'finish' END
    WHEN 11 THEN CASE k % 2 WHEN 0 THEN 'taken' ELSE 'not taken' END
    WHEN 12 THEN CASE k % 2 WHEN 0 THEN 'enter' ELSE 'exit' END WHEN 13 THEN ''
    WHEN 15 THEN CASE k % 2 WHEN 0 THEN 'enter · allocate' ELSE 'exit · free' END
    WHEN 17 THEN CASE k % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'child' ELSE 'finish' END
    ELSE CASE k % 4 WHEN 0 THEN 'memory unreadable' WHEN 1 THEN 'memory capture limit'
      WHEN 2 THEN 'write after without before' ELSE 'missing thread state' END END AS outcome,
  CASE kind WHEN 5 THEN {_HX.format('addr')} WHEN 6 THEN CASE reg WHEN 1 THEN 'rax' WHEN 2 THEN 'rbx'
    WHEN 3 THEN 'rcx' ELSE 'register #' || reg END WHEN 7 THEN {_HX.format('target')}
    WHEN 8 THEN {_HX.format('4096 + k % 7')} WHEN 11 THEN {_HX.format('k')} ELSE '' END AS storage,
  CASE kind WHEN 5 THEN hex WHEN 6 THEN hex WHEN 8 THEN 'RAX ' || {_HX.format('k * 3')}
    WHEN 7 THEN 'RCX ' || {_HX.format('k')} || ', RDX ' || {_HX.format('seq')} ELSE '' END AS captured_value
  FROM ev) e LEFT JOIN ins i ON e.iid = i.iid AND e.iid <> 0""")
def event_view(spark, sf):
    view = evidence.event_view(t.typed_tables(spark, sf), t.instructions(spark, sf),
                               evidence.register_catalog(t.registers(spark, sf)))
    return view.drop("run_id")


_LINES = "'sequence: ' || seq || chr(10) || 'monotonic_ns: ' || ns || chr(10) || 'thread_id: ' || tid || chr(10) || 'instruction_id: ' || iid || chr(10)"


@query("describe", duck("ev") + f""" SELECT seq, {_LINES} || 'target_function_id: 0' || chr(10) || 'target_address: ' || {_HX.format('k')} || chr(10)
    || 'fall_through_address: ' || {_HX.format('k + 1')} || chr(10) || 'taken: ' || (k % 2 = 0) || chr(10) || 'direct: true' || chr(10)
    || 'conditional: true' || chr(10) AS text FROM ev WHERE kind = 11
  UNION ALL SELECT seq, {_LINES} || 'address: ' || {_HX.format('k')} || chr(10) || 'requested: ' || k || chr(10) || 'captured: 0' || chr(10) || 'reason: '
    || CASE k % 4 WHEN 0 THEN 'memory_unreadable' WHEN 1 THEN 'memory_capture_limit' WHEN 2 THEN 'write_after_without_before'
    ELSE 'missing_thread_state' END || chr(10) FROM ev WHERE kind = 18""")
def describe(spark, sf):
    """Every field of branches and diagnostics as text."""
    tables = t.typed_tables(spark, sf)
    return evidence.detail_rows({n: tables[n] for n in ("branch_events", "capture_diagnostics")}).select("seq", "text")


@query("event_at", duck("ev") + " SELECT seq, kind, tid, iid FROM ev WHERE seq = (SELECT max(seq) // 2 FROM ev)")
def event_at(spark, sf):
    ev = t.evidence(spark, sf)
    middle = ev.agg(F.expr("max(seq) div 2")).first()[0]
    return evidence.event_at(ev, middle).select("seq", "kind", "tid", "iid")


@query("events_at_sequences", duck("ev") + " SELECT seq, kind, tid FROM ev WHERE seq IN (SELECT l_orderkey + 1 FROM "
       "lineitem) AND seq <= (SELECT max(event_id) FROM events)")
def events_at_sequences(spark, sf):
    last = t.read(spark, sf, "events").agg(F.max("event_id").alias("last"))
    wanted = (t.read(spark, sf, "lineitem").selectExpr("1L AS run_id", "l_orderkey + 1 AS seq").distinct()
              .join(last, F.col("seq") <= F.col("last"), "left_semi"))
    return evidence.events_at_sequences(t.evidence(spark, sf), wanted).select("seq", "kind", "tid")


@query("loaded_modules", duck("mods") + " SELECT module_id, load_seq AS sequence, size AS mapped_size FROM mods")
def loaded_modules(spark, sf):
    return big(evidence.loaded_modules(t.modules(spark, sf)), "mapped_size").select(
        "module_id", F.col("sequence").cast("bigint").alias("sequence"), "mapped_size")


@query("with_instruction", duck("ev", "ins") + """ SELECT seq, kind, ev.iid, routine, disassembly FROM ev
  LEFT JOIN ins ON ev.iid = ins.iid AND ev.iid <> 0""")
def with_instruction(spark, sf):
    rows = evidence.with_instruction(t.evidence(spark, sf), t.instructions(spark, sf))
    return rows.select("seq", "kind", "iid", "routine", "disassembly")


@query("register_catalog", duck("ev") + """ SELECT DISTINCT reg, CASE reg WHEN 1 THEN 'rax' WHEN 2 THEN 'rbx'
  WHEN 3 THEN 'rcx' ELSE 'register #' || reg END AS register_name FROM ev WHERE kind = 6""")
def register_catalog(spark, sf):
    rows = t.evidence(spark, sf).filter("kind = 6").select("run_id", "reg").distinct()
    return evidence.with_register_name(rows, evidence.register_catalog(t.registers(spark, sf))).select(
        "reg", "register_name")


@query("restrict_to_main", duck("ev", "ins", "mods") + """ SELECT kind, CAST(count(*) AS BIGINT) AS events FROM ev
  WHERE iid IN (SELECT iid FROM ins WHERE mid IN (SELECT module_id FROM mods WHERE module_id = 1)) GROUP BY kind""")
def restrict_to_main(spark, sf):
    rows = evidence.restrict_to_main(t.evidence(spark, sf), t.instructions(spark, sf), t.modules(spark, sf))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("events"))


@query("call_channels", duck("ev") + """ SELECT 'call' AS side, cid, seq, CAST(k AS VARCHAR) || ',' || seq || ',' || grp
  || ',' || tid AS integers FROM ev WHERE kind = 7
  UNION ALL SELECT 'return', cid, seq, (k * 3) || ',0' FROM ev WHERE kind = 8""")
def call_channels(spark, sf):
    tables = t.typed_tables(spark, sf)
    calls, returns = evidence.call_channels(tables["call_events"], tables["return_events"])
    return calls.select(F.lit("call").alias("side"), F.col("call_id").alias("cid"), "seq",
                        F.concat_ws(",", F.transform("integer_arguments", lambda v: v.cast("string"))).alias("integers")
                        ).union(returns.select(F.lit("return"), "call_id", "seq", F.concat_ws(
                            ",", F.col("rax").cast("string"), F.col("rdx").cast("string"))))


@query("capture_shortfall", duck("ev") + """ SELECT o_orderkey + 1 AS run_id, l_linenumber AS line, reason FROM (
  SELECT l_orderkey AS o_orderkey, l_linenumber, CASE WHEN captured < least(requested, 4) THEN 'memory_unreadable'
    WHEN requested > least(requested, 4) THEN 'memory_capture_limit' END AS reason FROM (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 9 AS requested,
    least(CAST(l_quantity AS BIGINT) % 9, l_partkey % 6) AS captured FROM lineitem WHERE l_returnflag <> 'R'))
  WHERE reason IS NOT NULL AND o_orderkey IN (SELECT o_orderkey FROM orders)""")
def capture_shortfall(spark, sf):
    memory = t.read(spark, sf, "lineitem").selectExpr(
        "l_orderkey + 1 AS run_id", "5 AS kind", "l_linenumber AS seq", "0L AS tid", "0L AS iid",
        "CAST(0 AS DECIMAL(20,0)) AS addr", "CAST(l_quantity AS BIGINT) % 9 AS requested",
        "CASE l_returnflag WHEN 'R' THEN 'prefetch' ELSE 'read' END AS access",
        "unhex(repeat('00', CAST(least(CAST(l_quantity AS BIGINT) % 9, l_partkey % 6) AS INT))) AS captured")
    return evidence.capture_shortfall(memory, t.run_rows(spark, sf)).select(
        "run_id", F.col("seq").alias("line"), "reason")


@query("capture_policy_notices", """SELECT o_orderkey + 1 AS run_id, 'policy_user_space_observations_exclude_kernel_and_external_memory_writes'
  AS reason FROM orders UNION ALL SELECT o_orderkey + 1, 'policy_main_scope_excludes_other_images_and_generated_code'
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') UNION ALL
  SELECT o_orderkey + 1, 'policy_register_capture_disabled' FROM orders WHERE NOT o_totalprice < 250000""")
def capture_policy_notices(spark, sf):
    return evidence.capture_policy_notices(t.run_rows(spark, sf))


_STORAGE_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN concat('0x', {hex}) WHEN 1 THEN concat(' 0x', {hex}, ':', o_custkey, ' ')
  WHEN 2 THEN concat('r', o_custkey) WHEN 3 THEN concat('0X', {hex}, ':', o_custkey % 300, ':1')
  WHEN 4 THEN concat('0x', {hex}, ':', o_custkey % 300) ELSE o_orderpriority END"""


@query("parse_storage", "SELECT o_orderkey, watch, kind AS watch_kind, CASE kind WHEN 'memory' THEN o_orderkey END "
       "AS address, CASE WHEN kind = 'memory' THEN sz WHEN kind = 'register' THEN 8 END AS size, "
       "CASE kind WHEN 'register' THEN lower(trim(watch)) END AS register FROM (SELECT *, CASE "
       "WHEN o_orderkey % 6 IN (0, 1, 4) AND sz BETWEEN 1 AND 256 THEN 'memory' WHEN o_orderkey % 6 = 2 THEN 'register' END "
       "AS kind FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 8 WHEN 1 THEN o_custkey WHEN 4 THEN "
       "o_custkey % 300 END AS sz, " + _STORAGE_TEXT.format(hex="printf('%x', o_orderkey)") + " AS watch FROM orders))")
def parse_storage(spark, sf):
    watches = t.read(spark, sf, "orders").selectExpr(
        "o_orderkey", _STORAGE_TEXT.format(hex="lower(hex(o_orderkey))") + " AS watch")
    return big(evidence.parse_storage(watches), "address", "size")


# --- counts ------------------------------------------------------------------------------------------

_COUNTS = "cnt AS (SELECT iid, tid, CAST(count(*) AS BIGINT) AS executions FROM ev WHERE kind = 4 GROUP BY iid, tid)"


@query("execution_counts", duck("ev") + f", {_COUNTS} SELECT iid, tid, executions FROM cnt")
def execution_counts(spark, sf):
    return coverage.execution_counts(t.evidence(spark, sf)).drop("run_id")


@query("hot_spots", duck("ev", "ins") + f""", {_COUNTS} SELECT mid, iid, routine, disassembly, executions, position FROM (
  SELECT *, row_number() OVER (PARTITION BY mid ORDER BY executions DESC, iid) AS position FROM (
    SELECT ins.mid, cnt.iid, any_value(routine) routine, any_value(disassembly) disassembly,
      CAST(sum(executions) AS BIGINT) AS executions FROM cnt JOIN ins ON cnt.iid = ins.iid GROUP BY ins.mid, cnt.iid))""")
def hot_spots(spark, sf):
    rows = coverage.hot_spots(coverage.execution_counts(t.evidence(spark, sf)), t.instructions(spark, sf))
    return rows.select("mid", "iid", "routine", "disassembly", "executions",
                       F.col("position").cast("bigint").alias("position"))


@query("execution_count_at", duck("ev", "ins") + """ SELECT mid, off, CAST(sum(CASE WHEN ev.iid IS NULL THEN 0 ELSE 1 END)
  AS BIGINT) AS executions FROM ins LEFT JOIN ev ON ev.iid = ins.iid AND kind = 4 GROUP BY mid, off""")
def execution_count_at(spark, sf):
    rows = coverage.execution_count_by_offset(coverage.execution_counts(t.evidence(spark, sf)), t.instructions(spark, sf))
    return big(rows, "off").drop("run_id")


@query("execution_count_one", duck("ev", "ins") + """ SELECT CAST(count(*) AS BIGINT) AS executions FROM ev
  WHERE kind = 4 AND iid IN (SELECT iid FROM ins WHERE mid = 3 AND off = 32)""")
def execution_count_one(spark, sf):
    counts = coverage.execution_counts(t.evidence(spark, sf))
    return coverage.execution_count(counts, t.instructions(spark, sf), 3, 32).select("executions")


@query("category_totals", duck("ev") + f""", {_CATEGORIES} SELECT category, tid, CAST(count(*) AS BIGINT) AS total FROM (
  SELECT category, unnest([-1, tid]) AS tid FROM ev, cats WHERE {_CATEGORY}) GROUP BY category, tid""")
def category_totals(spark, sf):
    return timeline.category_totals(t.evidence(spark, sf)).drop("run_id")


@query("recorded_threads", duck("ev") + " SELECT DISTINCT tid FROM ev WHERE kind IN (4, 5, 6, 7, 8, 9, 11, 12, 13, 15)")
def recorded_threads(spark, sf):
    return timeline.recorded_threads(t.evidence(spark, sf)).select("tid")


@query("timeline_page", duck("ev") + """, r AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS ordinal, count(*) OVER () AS total
    FROM ev WHERE kind IN (7, 8, 11, 13)),
  p AS (SELECT *, CAST(1 + (total - 1) // 300 AS BIGINT) AS pages FROM r)
  SELECT seq, ordinal, greatest(1, least(3, pages)) AS page, pages, total FROM p
  WHERE ordinal // 300 = greatest(1, least(3, pages)) - 1""")
def timeline_page(spark, sf):
    return timeline.timeline_page(t.evidence(spark, sf), 3, category="Control flow").select(
        "seq", "ordinal", F.col("page").cast("bigint").alias("page"), "pages", "total")


@query("timeline_page_at", duck("ev") + """, r AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS ordinal, count(*) OVER () AS total,
    count(*) FILTER (seq < 5000) OVER () AS earlier FROM ev WHERE kind IN (5, 6) AND access = 'write_after' AND tid = 2)
  SELECT seq, ordinal, ordinal // 100 + 1 AS page FROM r WHERE ordinal // 100 = least(earlier // 100, (total - 1) // 100)""")
def timeline_page_at(spark, sf):
    return timeline.timeline_page_at(t.evidence(spark, sf), 5000, 100, category="Writes", thread=2).select(
        "seq", "ordinal", F.col("page").cast("bigint").alias("page"))


@query("timeline_ordinals", duck("ev") + f""", {_CATEGORIES} SELECT category, seq,
  row_number() OVER (PARTITION BY category ORDER BY seq) - 1 AS ordinal FROM ev, cats WHERE {_CATEGORY}""")
def timeline_ordinals(spark, sf):
    return timeline.timeline_ordinals(t.evidence(spark, sf)).select("category", "seq", "ordinal")


@query("timeline_step", duck("ev") + """ (SELECT 'forward' AS direction, seq FROM ev WHERE kind = 15 AND seq >= 2000 ORDER BY seq LIMIT 20)
  UNION ALL (SELECT 'backward', seq FROM ev WHERE tid = 1 AND seq < 5000 ORDER BY seq DESC LIMIT 300)
  UNION ALL (SELECT 'through', seq FROM ev WHERE seq <= 4000 ORDER BY seq DESC LIMIT 300)""")
def timeline_step(spark, sf):
    ev = t.evidence(spark, sf)
    steps = [("forward", timeline.timeline_step(ev, 2000, forward=True, limit=20, category="Memory lifetime")),
             ("backward", timeline.timeline_step(ev, 5000, forward=False, limit=300, thread=1)),
             ("through", timeline.timeline_step(ev, 4000, forward=False, limit=300, through=True))]
    rows = [df.select(F.lit(name).alias("direction"), "seq") for name, df in steps]
    return rows[0].union(rows[1]).union(rows[2])


@query("offset_page", duck("ev") + " SELECT seq, kind FROM ev WHERE kind = 6 ORDER BY seq LIMIT 300 OFFSET 200")
def offset_page(spark, sf):
    return timeline.offset_page(t.evidence(spark, sf).filter("kind = 6"), 200, 300).select("seq", "kind")


# --- audits ------------------------------------------------------------------------------------------

@query("run_summary", duck("evr") + """ SELECT run_id, CAST(count(*) AS BIGINT) AS records, min(seq) AS first_seq, max(seq) AS last_seq,
  CAST(count(*) FILTER (kind = 18) AS BIGINT) AS diagnostics, CAST(max(width) AS BIGINT) AS max_width,
  CAST(count(*) FILTER (kind IN (5, 6) AND access <> 'prefetch') AS BIGINT) AS captured_samples,
  max(seq) - count(*) AS missing, run_id % 2 = 0 AS finished, run_id = 3 AS incomplete FROM evr GROUP BY run_id""")
def run_summary(spark, sf):
    """Every second run has a finish record, the tail of the third one is cut."""
    rows = t.evidence(spark, sf, runs=True)
    runs = rows.select("run_id").distinct()
    marks = runs.withColumn("started", F.lit(True)).unionByName(runs.filter("run_id % 2 = 0").withColumn("started", F.lit(False)))
    return audit.run_summary(rows, marks, runs.select("run_id", (F.col("run_id") == 3).alias("incomplete")))


@query("record_profile", duck("evr") + " SELECT run_id, kind, CAST(count(*) AS BIGINT) AS records FROM evr GROUP BY ALL")
def record_profile(spark, sf):
    return audit.record_profile(t.evidence(spark, sf, runs=True)).drop("dataset")


@query("time_profile", duck("ev") + """ SELECT ns // 1000000000 - (SELECT min(ns) // 1000000000 FROM ev) AS second,
  CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (kind = 4) AS BIGINT) AS instructions,
  CAST(count(*) FILTER (kind = 15) AS BIGINT) AS memory_api FROM ev GROUP BY ns // 1000000000""")
def time_profile(spark, sf):
    return audit.time_profile(t.evidence(spark, sf)).drop("run_id")


@query("time_span", duck("evr") + " SELECT run_id, max(ns) - min(ns) AS span_ns FROM evr GROUP BY run_id")
def time_span(spark, sf):
    return audit.time_span(t.evidence(spark, sf, runs=True))


@query("context_change_histogram", duck("ev") + """ SELECT k - 50 AS info, CAST(count(*) AS BIGINT) AS changes FROM ev
  WHERE kind = 13 GROUP BY k""")
def context_change_histogram(spark, sf):
    rows = audit.context_change_histogram(t.typed_tables(spark, sf)["context_change_events"])
    return big(rows, "info").drop("run_id")


@query("diagnostic_counts", duck("ev") + """ SELECT CASE k % 4 WHEN 0 THEN 'memory_unreadable' WHEN 1 THEN
  'memory_capture_limit' WHEN 2 THEN 'write_after_without_before' ELSE 'missing_thread_state' END AS reason,
  CAST(count(*) AS BIGINT) AS diagnostics FROM ev WHERE kind = 18 GROUP BY 1""")
def diagnostic_counts(spark, sf):
    return audit.diagnostic_counts(t.typed_tables(spark, sf)["capture_diagnostics"]).drop("run_id")


@query("sequence_audit", """SELECT l_suppkey + 1 AS run_id, CAST(count(*) AS BIGINT) AS records,
  CAST(count(DISTINCT l_orderkey) AS BIGINT) AS distinct_seqs, max(l_orderkey) + 1 AS last_seq,
  count(*) - count(DISTINCT l_orderkey) AS duplicates, max(l_orderkey) + 1 - count(DISTINCT l_orderkey) AS gaps
  FROM lineitem GROUP BY l_suppkey""")
def sequence_audit(spark, sf):
    """Line items as a damaged recording: order keys repeat and leave gaps within a supplier's run."""
    rows = t.read(spark, sf, "lineitem").selectExpr("l_suppkey + 1 AS run_id", "l_orderkey + 1 AS seq")
    return audit.sequence_audit(rows)


@query("run_verdict", """SELECT o_orderkey + 1 AS run_id, o_orderstatus = 'F' AND count(*) = max(l_linenumber) AND
  count(DISTINCT l_linenumber) = count(*) AS complete FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_orderstatus""")
def run_verdict(spark, sf):
    """Orders as runs, their line numbers as sequences."""
    lines = t.read(spark, sf, "lineitem").selectExpr("l_orderkey + 1 AS run_id", "CAST(l_linenumber AS BIGINT) AS seq")
    return audit.run_verdict(audit.sequence_audit(lines), t.run_rows(spark, sf)).select("run_id", "complete")


@query("write_pairing_audit", duck("ev") + """, w AS (SELECT *, lag(access) OVER k AS p_access, lag(addr) OVER k AS p_addr,
    lag(width) OVER k AS p_width, lead(seq) OVER k AS n_seq FROM ev
    WHERE kind = 5 AND access IN ('write_before', 'write_after') WINDOW k AS (PARTITION BY tid, iid ORDER BY seq)),
  fin AS (SELECT tid, max(seq) AS last FROM ev WHERE kind = 9 AND k % 2 = 1 GROUP BY tid),
  cut AS (SELECT w.seq, count(*) AS n FROM w JOIN ev c ON c.kind = 13 AND c.tid = w.tid AND c.seq > w.seq
    AND (w.n_seq IS NULL OR c.seq < w.n_seq) WHERE w.access = 'write_before' GROUP BY w.seq)
  SELECT tid, iid, reason, notice_seq, address, CAST(requested AS BIGINT) AS requested, CAST(times AS BIGINT) AS times FROM (
    SELECT tid, iid, 'write_after_unobserved_before_reexecution' AS reason, seq AS notice_seq, p_addr AS address,
      p_width AS requested, 1 AS times FROM w WHERE access = 'write_before' AND p_access = 'write_before'
    UNION ALL SELECT tid, iid, 'write_after_without_before', seq, 0, 0, 1 FROM w
      WHERE access = 'write_after' AND coalesce(p_access, '') <> 'write_before'
    UNION ALL SELECT tid, iid, 'write_interrupted_by_context_change', seq, addr, width, n FROM w JOIN cut USING (seq)
    UNION ALL SELECT tid, iid, 'write_after_unobserved_at_thread_end', last, addr, width, 1 FROM w JOIN fin USING (tid)
      WHERE access = 'write_before' AND n_seq IS NULL)""")
def write_pairing_audit(spark, sf):
    rows = audit.write_pairing_audit(t.evidence(spark, sf), t.typed_tables(spark, sf)["thread_events"])
    return big(rows, "address", "requested").drop("run_id", "operand")


@query("check_memory_oracle", """WITH s AS (SELECT p_partkey * 16 AS address, p_partkey, p_size, unnest(range(2 * p_size)) AS i FROM part)
  SELECT address, CAST(any_value(p_size) AS BIGINT) AS expected, CAST(count(*) AS BIGINT) AS samples,
  CAST(count(*) FILTER (i % 2 = 1) AS BIGINT) AS observed, CAST(count(*) FILTER ((p_partkey + i) % 97 = 0) AS BIGINT) AS errors
  FROM s GROUP BY address""")
def check_memory_oracle(spark, sf):
    """Parts as slots with p_size stores each; every 97th sample holds a wrong value."""
    part = t.read(spark, sf, "part").selectExpr("p_partkey", "p_size", "1L AS run_id",
                                                "CAST(p_partkey * 16 AS DECIMAL(20,0)) AS address")
    expected = part.selectExpr("run_id", "address", "'slot' AS slot_kind", "CAST(p_size AS BIGINT) AS expected")
    samples = part.selectExpr("*", "explode(sequence(0, 2 * p_size - 1)) AS i").selectExpr(
        "run_id", "5 AS kind", "address AS addr", "p_partkey * 200 + i AS seq", "3L AS tid", "p_partkey + 1 AS iid",
        "CASE i % 2 WHEN 0 THEN 'write_before' ELSE 'write_after' END AS access", "8L AS requested",
        "unhex(rpad(lpad(hex(CASE WHEN (p_partkey + i) % 97 = 0 THEN 99 ELSE (i + 1) div 2 END), 2, '0'), 16, '0')) AS captured")
    none = samples.selectExpr("run_id", "addr AS address", "access AS reason").filter("reason = 'memory_unreadable'")
    rows = audit.check_memory_oracle(expected, samples, none, t.instructions(spark, sf))
    return big(rows, "address", "errors").drop("run_id", "slot_kind")


@query("check_register_oracle", """WITH s AS (SELECT c_custkey, c_nationkey, unnest(range(1 + c_nationkey)) AS i FROM customer)
  SELECT c_custkey + 1 AS pc, CAST(count(*) AS BIGINT) AS observed, CAST(count(*) AS BIGINT) + (any_value(c_custkey) % 7 = 0)::INT AS expected,
  CAST(count(*) FILTER ((c_custkey + i) % 31 = 0) AS BIGINT) + (any_value(c_custkey) % 7 = 0)::INT AS errors
  FROM s GROUP BY c_custkey""")
def check_register_oracle(spark, sf):
    """Customers as code places; wrong values and missing observations follow from the keys."""
    place = t.read(spark, sf, "customer").selectExpr(
        "1L AS run_id", "c_custkey", "c_custkey + 1 AS iid", "c_nationkey AS n",
        "CAST(c_custkey + 1 AS DECIMAL(20,0)) AS pc")
    samples = place.selectExpr("*", "explode(sequence(0, n)) AS i").selectExpr(
        "run_id", "6 AS kind", "iid", "1L AS reg", "c_custkey * 100 + i AS seq", "'write_after' AS access",
        "unhex(rpad(lpad(hex(CASE WHEN (c_custkey + i) % 31 = 0 THEN 255 ELSE i END), 2, '0'), 16, '0')) AS captured")
    expected = place.selectExpr("*", "explode(sequence(0, n + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END)) AS i").selectExpr(
        "run_id", "pc", "'rax' AS register", "'write_after' AS access", "CAST(i AS BIGINT) AS ordinal",
        "CAST(255 AS DECIMAL(20,0)) AS mask", "CAST(i AS DECIMAL(20,0)) AS value")
    code = place.selectExpr("run_id", "iid", "pc AS address")
    registers = place.selectExpr("run_id", "1L AS reg", "'rax' AS register_name").distinct()
    rows = audit.check_register_oracle(expected, samples, code, registers)
    return big(rows, "pc", "errors").drop("run_id", "register", "access")
