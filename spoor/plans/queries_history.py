"""Queries: histories, values at a moment, calls, correlation."""

from pyspark.sql import functions as F

from spoor.functions import bytes as B
from spoor.operators import calls, evidence, history, memory_api
from spoor.plans import tables as t
from spoor.plans.registry import big, query
from spoor.plans.tables import duck

_OVERLAP = "kind = 5 AND access <> 'prefetch' AND addr < 16 AND addr + width > 8"


@query("history_memory", duck("ev") + f""" SELECT seq, tid, iid, addr, access, hex FROM ev WHERE {_OVERLAP}
  AND seq <= (SELECT max(seq) * 9 // 10 FROM ev)""")
def history_memory(spark, sf):
    ev = t.evidence(spark, sf)
    cursor = ev.agg(F.expr("max(seq) * 9 div 10")).first()[0]
    rows = history.history_memory(ev, 8, 8, cursor, max_width=8)
    return big(rows, "addr").select("seq", "tid", "iid", "addr", "access", B.hex_text("captured").alias("hex"))


@query("history_memory_writes", duck("ev") + """ SELECT seq, tid, access FROM ev WHERE kind = 5
  AND access IN ('write_before', 'write_after') AND addr < 16 AND addr + width > 8""")
def history_memory_writes(spark, sf):
    rows = history.history_memory(t.evidence(spark, sf), 8, 8, 1 << 60, writes_only=True, limit=None)
    return rows.select("seq", "tid", "access")


_WATCHES = """SELECT s_suppkey AS watch_id, (s_suppkey {div} 100) * 64 + s_suppkey % 50 AS address,
  1 + s_suppkey % 16 AS size, (s_suppkey {div} 100) * 10000 + 100 * (s_suppkey % 100 + 1) AS cursor FROM supplier"""


def _watches(spark, sf):
    """One watch per supplier, its moment inside the stretch of events that uses its addresses."""
    return t.read(spark, sf, "supplier").selectExpr(
        "s_suppkey AS watch_id", "1L AS run_id",
        "CAST((s_suppkey div 100) * 64 + s_suppkey % 50 AS DECIMAL(20,0)) AS address",
        "CAST(1 + s_suppkey % 16 AS INT) AS size", "(s_suppkey div 100) * 10000 + 100 * (s_suppkey % 100 + 1) AS cursor")


_HITS = "watches AS (" + _WATCHES.format(div="//") + """), hits AS (SELECT watch_id, address, size, cursor, ev.* FROM watches
  JOIN ev ON kind = 5 AND access <> 'prefetch' AND addr < address + size AND addr + width > address AND seq <= cursor)"""


@query("history_memory_batch", duck("ev") + f""", {_HITS} SELECT watch_id, seq, addr, access FROM hits""")
def history_memory_batch(spark, sf):
    rows = history.history_memory_batch(t.evidence(spark, sf), _watches(spark, sf))
    return big(rows, "addr").select("watch_id", "seq", "addr", "access")


@query("byte_state", duck("ev") + f""", {_HITS}, cells AS (SELECT watch_id, pos, max(seq) AS seq,
    arg_max(CASE WHEN address + pos - addr < length(hex) // 2 THEN substr(hex, 2 * (address + pos - addr) + 1, 2) ELSE '??' END, seq) AS byte,
    arg_max(access, seq) AS access
    FROM (SELECT *, unnest(range(size)) AS pos FROM hits) WHERE pos + address >= addr AND pos + address < addr + width
    GROUP BY watch_id, pos),
  shown AS (SELECT watch_id, string_agg(coalesce(byte, '??'), ' ' ORDER BY pos) AS value FROM
    (SELECT watch_id, unnest(range(size)) AS pos FROM watches) LEFT JOIN cells USING (watch_id, pos) GROUP BY watch_id),
  found AS (SELECT watch_id, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq DESC) AS sources, bool_or(before) AS before_write
    FROM (SELECT watch_id, seq, bool_or(access = 'write_before') AS before FROM cells GROUP BY watch_id, seq) GROUP BY watch_id)
  SELECT watch_id, value, coalesce(sources, '') AS sources, coalesce(before_write, false) AS before_write,
    CASE WHEN value LIKE '%?%' THEN 'partial' WHEN size > 8 THEN 'bytes' ELSE 'number' END AS reading
  FROM watches JOIN shown USING (watch_id) LEFT JOIN found USING (watch_id)""")
def byte_state(spark, sf):
    rows = history.byte_state(t.evidence(spark, sf), _watches(spark, sf), segment=1024)
    reading = F.when(F.col("number").isNotNull(), "number").when(F.contains("value", F.lit("?")), "partial").otherwise("bytes")
    return rows.select("watch_id", "value", F.concat_ws(",", F.transform("sources", lambda s: s.cast("string"))).alias("sources"),
                       "before_write", reading.alias("reading"))


@query("register_state", duck("ev") + """, w AS (SELECT s_suppkey AS watch_id, s_suppkey % 5 AS reg, s_suppkey % 8 AS tid,
    s_suppkey % 10 AS off, 1 + s_suppkey % 6 AS size, 100 * (s_suppkey + 1) AS cursor FROM supplier),
  hit AS (SELECT watch_id, max(seq) AS source, arg_max(hex, seq) AS hex, arg_max(access, seq) AS access FROM w JOIN ev
    ON ev.kind = 6 AND ev.reg = w.reg AND ev.tid = w.tid AND seq <= cursor GROUP BY watch_id),
  cells AS (SELECT watch_id, off, unnest(range(size)) AS i FROM w)
  SELECT watch_id, any_value(source) AS source, coalesce(any_value(access) = 'write_before', false) AS before_write,
    string_agg(CASE WHEN (i + off) * 2 < length(hex) THEN substr(hex, 2 * (i + off) + 1, 2) ELSE '??' END, ' ' ORDER BY i) AS value
  FROM cells LEFT JOIN hit USING (watch_id) GROUP BY watch_id""")
def register_state(spark, sf):
    watches = t.read(spark, sf, "supplier").selectExpr(
        "s_suppkey AS watch_id", "1L AS run_id", "s_suppkey % 5 AS reg", "s_suppkey % 8 AS tid",
        "s_suppkey % 10 AS offset", "1 + s_suppkey % 6 AS size", "100 * (s_suppkey + 1) AS cursor")
    return history.register_state(t.evidence(spark, sf), watches, segment=1024).select("watch_id", "source", "before_write", "value")


@query("history_register", duck("ev") + """ SELECT seq, access, hex FROM ev WHERE kind = 6 AND reg = 2 AND tid = 3
  AND access IN ('write_before', 'write_after')""")
def history_register(spark, sf):
    names = evidence.register_catalog(t.registers(spark, sf))
    rows = history.history_register(t.evidence(spark, sf), names, "RBX", 3, 1 << 60, writes_only=True)
    return rows.select("seq", "access", B.hex_text("captured").alias("hex"))


@query("history_calls", duck("ev") + """ SELECT seq, tid, cid FROM ev WHERE kind = 7 AND target = 3
  AND seq <= (SELECT max(seq) * 9 // 10 FROM ev)""")
def history_calls(spark, sf):
    ev = t.evidence(spark, sf)
    cursor = ev.agg(F.expr("max(seq) * 9 div 10")).first()[0]
    return history.history_calls(ev, 3, cursor).select("seq", "tid", "cid")


@query("events_at", duck("ev", "ins") + """ SELECT seq, kind, tid, iid FROM ev WHERE iid IN
  (SELECT iid FROM ins WHERE mid = 3 AND off = 32)""")
def events_at(spark, sf):
    rows = history.events_at(t.evidence(spark, sf), t.instructions(spark, sf), 3, 32, 1 << 60)
    return rows.select("seq", "kind", "tid", "iid")


_TRANSITIONS = """, b AS (SELECT w.seq, w.kind, w.tid, w.iid, w.hex, max(p.seq) AS before_seq, arg_max(p.hex, p.seq) AS before_hex
    FROM ev w LEFT JOIN ev p ON p.kind = w.kind AND p.tid = w.tid AND p.iid = w.iid AND p.addr = w.addr AND p.reg = w.reg
      AND p.access = 'write_before' AND p.seq < w.seq
    WHERE w.kind IN (5, 6) AND w.access = 'write_after' GROUP BY ALL),
  s AS (SELECT b.*, EXISTS (SELECT 1 FROM ev x WHERE x.kind = 4 AND x.iid = b.iid AND x.tid = b.tid
      AND x.seq > b.before_seq AND x.seq < b.seq) AS ran FROM b),
  tr AS (SELECT *, CASE WHEN before_seq IS NULL THEN 'no_before_sample' WHEN ran THEN 'earlier_execution' ELSE 'paired' END AS outcome
    FROM s)"""
_CHANGED = ("CAST(list_sum(list_transform(range(least(length(hex), length(before_hex)) // 2), lambda i: "
            "CASE WHEN substr(hex, 2 * i + 1, 2) <> substr(before_hex, 2 * i + 1, 2) THEN 1 ELSE 0 END)) AS BIGINT)")


@query("write_transition", duck("ev") + _TRANSITIONS + f""" SELECT seq, kind, iid, outcome,
  CASE outcome WHEN 'paired' THEN before_seq END AS before_seq, CASE outcome WHEN 'paired' THEN {_CHANGED} END AS changed,
  CASE outcome WHEN 'paired' THEN least(length(hex), length(before_hex)) // 2 END AS compared FROM tr""")
def write_transition(spark, sf):
    return big(history.write_transition(t.evidence(spark, sf)), "changed", "compared").select(
        "seq", "kind", "iid", "outcome", "before_seq", "changed", "compared")


@query("related_rows", duck("ev", "ins") + _TRANSITIONS + """ SELECT ev.seq, ev.kind, routine, disassembly, outcome,
  CASE outcome WHEN 'paired' THEN before_seq END AS before_seq FROM ev LEFT JOIN ins ON ev.iid = ins.iid AND ev.iid <> 0
  LEFT JOIN tr ON tr.seq = ev.seq WHERE ev.seq IN (SELECT l_orderkey + 1 FROM lineitem)""")
def related_rows(spark, sf):
    chosen = t.read(spark, sf, "lineitem").selectExpr("1L AS run_id", "l_orderkey + 1 AS seq")
    rows = history.related_rows(t.evidence(spark, sf), t.instructions(spark, sf), chosen)
    return rows.select("seq", "kind", "routine", "disassembly", "outcome", "before_seq")


# --- calls -------------------------------------------------------------------------------------------

_LIFE = """, ret AS (SELECT cid, tid, min(seq) AS returned FROM ev WHERE kind = 8 GROUP BY cid, tid),
  life AS (SELECT c.seq, c.tid, c.cid, c.target, returned FROM ev c LEFT JOIN ret USING (cid, tid) WHERE c.kind = 7)"""


@query("call_lifetimes", duck("ev") + _LIFE + " SELECT seq, tid, cid, target, returned FROM life")
def call_lifetimes(spark, sf):
    return big(calls.call_lifetimes(t.evidence(spark, sf)), "target").drop("run_id")


@query("returned_asof", duck("ev") + """ SELECT c.cid, c.tid, c.seq, max(r.seq) AS return_seq FROM ev c LEFT JOIN ev r
  ON r.kind = 8 AND r.cid = c.cid AND r.tid = c.tid AND r.seq <= (SELECT max(seq) // 2 FROM ev)
  WHERE c.kind = 7 AND c.seq <= (SELECT max(seq) // 2 FROM ev) GROUP BY ALL""")
def returned_asof(spark, sf):
    ev = t.evidence(spark, sf)
    cursor = ev.agg(F.expr("max(seq) div 2")).first()[0]
    return calls.returned(ev, cursor).drop("run_id")


@query("match_call", duck("ev") + """ SELECT cid, seq, kind, position FROM (SELECT *, row_number() OVER
  (PARTITION BY cid ORDER BY seq) AS position FROM ev WHERE kind IN (7, 8) AND cid <> 0)""")
def match_call(spark, sf):
    return calls.match_call(t.evidence(spark, sf)).select("cid", "seq", "kind", F.col("position").cast("bigint").alias("position"))


@query("call_latency", duck("ev") + """ SELECT c.cid AS call_id, c.tid, c.seq, c.target, c.k AS rcx, max(r.seq) AS return_seq,
  arg_max(r.k * 3, r.seq) AS rax, arg_max(r.ns, r.seq) - c.ns AS latency_ns FROM ev c LEFT JOIN ev r
  ON r.kind = 8 AND r.cid = c.cid AND r.tid = c.tid WHERE c.kind = 7 GROUP BY c.cid, c.tid, c.seq, c.target, c.k, c.ns""")
def call_latency(spark, sf):
    tables = t.typed_tables(spark, sf)
    rows = calls.call_latency(tables["call_events"], tables["return_events"])
    return big(rows, "target", "rcx", "rax").drop("run_id", "rdx", "r8", "r9")


_ACTIVE = _LIFE + """, cur AS (SELECT seq AS cursor_id, tid, seq AS cursor FROM ev WHERE kind IN (9, 18)),
  bound AS (SELECT cursor_id, any_value(cur.tid) AS tid, any_value(cursor) AS cursor, coalesce(max(x.seq), 0) AS boundary FROM cur LEFT JOIN ev x
    ON x.kind = 13 AND x.tid = cur.tid AND x.seq <= cursor GROUP BY cursor_id),
  act AS (SELECT cursor_id, life.* FROM bound JOIN life ON life.tid = bound.tid AND life.seq > boundary AND life.seq < cursor
    AND (returned IS NULL OR returned > cursor))"""


def _cursors(ev):
    """Every thread event and capture diagnostic is a moment to look at."""
    return ev.filter("kind IN (9, 18)").selectExpr("seq AS cursor_id", "run_id", "tid", "seq AS cursor")


@query("active_calls", duck("ev") + _ACTIVE + " SELECT cursor_id, seq, cid, target, returned FROM act")
def active_calls(spark, sf):
    ev = t.evidence(spark, sf)
    return big(calls.active_calls(ev, _cursors(ev)), "target").select("cursor_id", "seq", "cid", "target", "returned")


@query("resolve_stack", duck("ev") + _ACTIVE + """, top AS (SELECT cursor_id, target, max(seq) AS call_seq FROM act GROUP BY ALL)
  SELECT cur.cursor_id AS watch_id, call_seq, 1000000 + call_seq - 8 + 16 AS address FROM cur LEFT JOIN top
  ON top.cursor_id = cur.cursor_id AND top.target = cur.cursor % 5 + 1""")
def resolve_stack(spark, sf):
    ev = t.evidence(spark, sf)
    watches = _cursors(ev).selectExpr("cursor_id AS watch_id", "run_id", "tid", "cursor",
                                      "CAST(cursor % 5 + 1 AS DECIMAL(20,0)) AS target", "16 AS offset", "8 AS size")
    rows = calls.resolve_stack(ev, t.typed_tables(spark, sf)["call_events"], watches)
    return big(rows, "address").select("watch_id", "call_seq", "address")


_DEEP = """SELECT o_orderkey + 1 AS seq, 1 + o_orderkey % 997 AS target FROM orders"""


@query("resolve_stack_deep", f"""WITH c AS ({_DEEP}), e AS (SELECT max(seq) AS top FROM c), n AS (SELECT max(s_suppkey) AS many FROM supplier),
  w AS (SELECT s_suppkey AS watch_id, 1 + s_suppkey % 997 AS target, 1 + s_suppkey * top // many AS cursor FROM supplier, e, n)
  SELECT watch_id, max(seq) AS call_seq, 1000000 + max(seq) - 8 + 16 AS address FROM w LEFT JOIN c ON c.target = w.target AND seq < cursor
  GROUP BY watch_id""")
def resolve_stack_deep(spark, sf):
    """Orders as calls that never return, seen by a watch per supplier all along the run: most functions lie hundreds of frames deep."""
    rows = t.read(spark, sf, "orders").selectExpr(
        "1L AS run_id", "o_orderkey + 1 AS seq", "7 AS kind", "1L AS tid", "o_orderkey + 1 AS cid",
        "CAST(1 + o_orderkey % 997 AS DECIMAL(20,0)) AS target")
    pointers = rows.selectExpr("run_id", "seq AS sequence", "CAST(1000000 + seq AS DECIMAL(20,0)) AS stack_pointer")
    suppliers = t.read(spark, sf, "supplier")
    top, many = rows.agg(F.max("seq")).first()[0], suppliers.agg(F.max("s_suppkey")).first()[0]
    watches = suppliers.selectExpr(
        "CAST(s_suppkey AS BIGINT) AS watch_id", "1L AS run_id", "1L AS tid", f"1 + s_suppkey * {top}L div {many} AS cursor",
        "CAST(1 + s_suppkey % 997 AS DECIMAL(20,0)) AS target", "16 AS offset", "8 AS size")
    return big(calls.resolve_stack(rows, pointers, watches), "address").select("watch_id", "call_seq", "address")


@query("correlate_calls", duck("ev", recursive=True) + """, r AS (SELECT tid, seq, kind, grp AS cid, CASE kind WHEN 7 THEN 4096 + k % 5
    ELSE 4096 + k % 7 END AS address, row_number() OVER (PARTITION BY tid ORDER BY seq) AS n FROM ev WHERE kind IN (7, 8)),
  s AS (SELECT tid, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 0 AS kind, CAST([] AS BIGINT[]) AS ids,
      CAST([] AS BIGINT[]) AS addrs, CAST(0 AS BIGINT) AS call_id, CAST(0 AS BIGINT) AS depth, false AS matched FROM (SELECT DISTINCT tid FROM r)
    UNION ALL SELECT q.tid, q.n, q.seq, q.kind,
      CASE WHEN q.kind = 7 THEN list_append(q.ids, q.cid) WHEN q.hit > 0 THEN q.ids[1:q.hit - 1] ELSE q.ids END,
      CASE WHEN q.kind = 7 THEN list_append(q.addrs, q.address) WHEN q.hit > 0 THEN q.addrs[1:q.hit - 1] ELSE q.addrs END,
      CASE WHEN q.kind = 7 THEN q.cid WHEN q.hit > 0 THEN q.ids[q.hit] ELSE 0 END,
      CASE WHEN q.kind = 8 AND q.hit > 0 THEN q.hit - 1 ELSE len(q.ids) END, q.kind = 7 OR q.hit > 0
    FROM (SELECT s.ids, s.addrs, r.*, CASE WHEN list_contains(s.addrs, r.address)
        THEN len(s.addrs) + 1 - list_position(list_reverse(s.addrs), r.address) ELSE 0 END AS hit
      FROM s JOIN r ON r.tid = s.tid AND r.n = s.n + 1) q)
  SELECT tid, seq, kind, call_id, depth, matched FROM s WHERE n > 0""")
def correlate_calls(spark, sf):
    rows = t.event_rows(spark, sf).filter("kind IN (7, 8)").selectExpr(
        "1L AS run_id", "tid", "seq", "kind", "grp AS call_id",
        "CASE kind WHEN 7 THEN 4096 + k % 5 ELSE 4096 + k % 7 END AS address")
    return calls.correlate_calls(rows).drop("run_id")


_LIFO = """ SELECT *, coalesce(last_value(CASE WHEN entering THEN seq END IGNORE NULLS) OVER (PARTITION BY {key}, level ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), NULL) AS opened FROM (
  SELECT *, CASE WHEN entering THEN s - m ELSE s - m0 + 1 END AS level, NOT entering AND s < m0 AS orphan FROM (
  SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY {key} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS m0,
    least(0, min(s) OVER (PARTITION BY {key} ORDER BY seq)) AS m FROM (
  SELECT *, sum(CASE WHEN entering THEN 1 ELSE -1 END) OVER (PARTITION BY {key} ORDER BY seq) AS s FROM {rows})))"""


@query("correlate_syscalls", duck("ev") + """, e AS (SELECT tid, seq, kind, k % 2 = 0 AS entering,
    count(*) FILTER (kind = 13) OVER (PARTITION BY tid ORDER BY seq) AS epoch FROM ev),
  x AS (SELECT tid, seq, entering, epoch FROM e WHERE kind <> 13), p AS (""" + _LIFO.format(key="tid, epoch", rows="x") + """)
  SELECT tid, seq, entering, epoch, CASE WHEN NOT entering AND NOT orphan THEN opened END AS enter_seq FROM p""")
def correlate_syscalls(spark, sf):
    """Every event as a system-call enter or exit, context changes as they are."""
    ev = t.event_rows(spark, sf)
    rows = ev.filter("kind <> 13").selectExpr("1L AS run_id", "tid", "seq", "k % 2 = 0 AS entering")
    changes = ev.filter("kind = 13").selectExpr("1L AS run_id", "tid", "seq")
    return calls.correlate_syscalls(rows, changes).drop("run_id")


@query("interrupted_syscalls", duck("ev") + """, e AS (SELECT tid, seq, kind, k % 2 = 0 AS entering,
    count(*) FILTER (kind = 13) OVER (PARTITION BY tid ORDER BY seq) AS epoch FROM ev),
  x AS (SELECT tid, seq, entering, epoch FROM e WHERE kind <> 13), p AS (""" + _LIFO.format(key="tid, epoch", rows="x") + """),
  o AS (SELECT tid, epoch, count(*) AS requested FROM p WHERE entering AND seq NOT IN
    (SELECT opened FROM p WHERE NOT entering AND NOT orphan) GROUP BY tid, epoch)
  SELECT e.tid, e.seq, requested FROM e JOIN o ON o.tid = e.tid AND o.epoch = e.epoch - 1 WHERE e.kind = 13""")
def interrupted_syscalls(spark, sf):
    ev = t.event_rows(spark, sf)
    rows = ev.filter("kind <> 13").selectExpr("1L AS run_id", "tid", "seq", "k % 2 = 0 AS entering")
    changes = ev.filter("kind = 13").selectExpr("1L AS run_id", "tid", "seq")
    pairs = calls.correlate_syscalls(rows, changes)
    return calls.interrupted_syscalls(pairs, changes).select("tid", "seq", "requested")


@query("correlate_memory_apis", duck("ev") + ", x AS (SELECT tid, seq, k % 3 + 1 AS definition, k % 2 = 0 AS entering FROM ev), p AS ("
       + _LIFO.format(key="tid, definition", rows="x") + """) SELECT tid, seq, definition, entering, orphan,
  CASE WHEN NOT entering AND NOT orphan THEN opened END AS enter_seq FROM p""")
def correlate_memory_apis(spark, sf):
    """Every event as entry or exit of one of three routines."""
    rows = t.event_rows(spark, sf).selectExpr("1L AS run_id", "tid", "seq", "k % 3 + 1 AS definition", "k % 2 = 0 AS entering")
    return memory_api.correlate(rows).select("tid", "seq", "definition", "entering", "orphan",
                                             F.col("enter").alias("enter_seq"))


_SPAN = """x AS (SELECT o_orderkey AS id, o_custkey % 8 AS tid, o_orderkey * 2 + 1 AS seq, o_orderstatus AS st,
  o_custkey % 40 AS number FROM orders)"""


@query("syscall_spans", f"""WITH {_SPAN} SELECT CASE WHEN st = 'O' THEN 0 ELSE id + 1 END AS syscall_id, tid, number,
  CASE WHEN st <> 'O' THEN seq END AS enter_seq, CASE WHEN st <> 'P' THEN seq + 1 END AS exit_seq,
  CASE WHEN st = 'F' THEN CAST(1000 AS BIGINT) END AS duration_ns FROM x""")
def syscall_spans(spark, sf):
    """Orders as system calls: open orders lost their enter, orders in process their exit."""
    rows = t.read(spark, sf, "orders").selectExpr(
        "1L AS run_id", "o_orderkey", "o_orderstatus", "o_custkey",
        "explode(CASE o_orderstatus WHEN 'P' THEN array(true) WHEN 'O' THEN array(false) ELSE array(true, false) END) AS entering"
    ).selectExpr(
        "run_id", "CASE o_orderstatus WHEN 'O' THEN 0 ELSE o_orderkey + 1 END AS syscall_id", "o_custkey % 8 AS thread_id",
        "o_orderkey * 2 + CASE WHEN entering THEN 1 ELSE 2 END AS sequence", "entering",
        "CAST(o_custkey % 40 AS DECIMAL(20,0)) AS number", "CAST(o_custkey AS DECIMAL(20,0)) AS return_value"
    ).withColumn("monotonic_ns", F.col("sequence") * 1000)
    return big(calls.syscall_spans(rows), "number").drop("run_id", "return_value")


# Fixed values, written out a second time so that the oracles do not lean on the operator's own table.
_API = """(0, 'VirtualAlloc', 'allocate'), (1, 'VirtualFree', 'free'), (2, 'VirtualProtect', 'protect'), (3, 'HeapAlloc', 'allocate'),
  (4, 'HeapReAlloc', 'reallocate'), (5, 'HeapFree', 'free'), (6, 'RtlAllocateHeap', 'allocate'), (7, 'RtlReAllocateHeap', 'reallocate'),
  (8, 'RtlFreeHeap', 'free'), (9, 'NtAllocateVirtualMemory', 'allocate'), (10, 'NtFreeVirtualMemory', 'free'),
  (11, 'NtProtectVirtualMemory', 'protect'), (12, 'MapViewOfFile', 'map'), (13, 'MapViewOfFileEx', 'map'), (14, 'UnmapViewOfFile', 'unmap'),
  (15, 'MapViewOfFile3', 'map'), (16, 'UnmapViewOfFile2', 'unmap'), (17, 'NtMapViewOfSection', 'map'), (18, 'NtUnmapViewOfSection', 'unmap')"""
_API_NAMES = [n for n, _ in memory_api.ROUTINES] + ["virtualalloc", "HeapAlloc2", "malloc"]


@query("memory_operations", f"""WITH {_SPAN}, names(n, routine, action) AS (VALUES {_API})
  SELECT CASE WHEN st = 'O' THEN 0 ELSE id + 1 END AS operation_id, tid, number % 19 + 1 AS definition_id, routine,
  CASE WHEN st <> 'O' THEN seq END AS enter_seq, CASE WHEN st <> 'P' THEN seq + 1 END AS exit_seq,
  CASE WHEN st = 'P' THEN NULL WHEN st = 'F' AND number % 19 IN (10, 11, 17) THEN id + 7 ELSE 5 END AS previous, st = 'F' AS matched
  FROM x JOIN names ON n = number % 19""")
def memory_operations(spark, sf):
    rows = t.read(spark, sf, "orders").selectExpr(
        "1L AS run_id", "o_orderkey", "o_orderstatus", "o_custkey",
        "explode(CASE o_orderstatus WHEN 'P' THEN array(true) WHEN 'O' THEN array(false) ELSE array(true, false) END) AS entering"
    ).selectExpr(
        "run_id", "CASE o_orderstatus WHEN 'O' THEN 0 ELSE o_orderkey + 1 END AS operation_id", "o_custkey % 8 AS thread_id",
        "o_orderkey * 2 + CASE WHEN entering THEN 1 ELSE 2 END AS sequence", "entering",
        "o_custkey % 40 % 19 + 1 AS definition_id", "'allocate' AS action", "CAST(1 AS DECIMAL(20,0)) AS result",
        "CAST(o_orderkey + 7 AS DECIMAL(20,0)) AS base_address", "CAST(5 AS DECIMAL(20,0)) AS previous_address",
        "CAST(8 AS DECIMAL(20,0)) AS size", "true AS succeeded")
    names = rows.select("run_id", "definition_id").distinct().withColumn(
        "kind", F.col("definition_id") - 1).withColumn(
        "name", F.element_at(F.array(*[F.lit(n) for n, _ in memory_api.ROUTINES]), F.col("definition_id").cast("int")))
    done = memory_api.memory_operations(rows, names)
    return big(done, "previous").select("operation_id", "tid", "definition_id", "routine", "enter_seq", "exit_seq",
                                        "previous", "matched")


@query("classify_memory_api", f"""WITH names(n, name, action) AS (VALUES {_API}, (19, 'virtualalloc', NULL), (20, 'HeapAlloc2', NULL), (21, 'malloc', NULL))
  SELECT p_partkey, name, CASE WHEN action IS NOT NULL THEN CAST(n AS BIGINT) END AS api_kind, action FROM part JOIN names ON n = p_size % 22""")
def classify_memory_api(spark, sf):
    rows = t.read(spark, sf, "part").select(
        "p_partkey", F.element_at(F.array(*[F.lit(n) for n in _API_NAMES]), F.expr("p_size % 22 + 1")).alias("name"))
    return big(memory_api.classify(rows), "api_kind")


@query("interpret_memory_api", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 19 AS kind, l_suppkey % 2 = 0 AS entering,
    l_quantity::BIGINT % 5 AS result, l_orderkey AS a, l_partkey AS b FROM lineitem)
  SELECT l_orderkey, l_linenumber, kind,
    CASE WHEN kind IN (9, 10, 11, 17) THEN NULL WHEN kind IN (1, 2, 14) THEN a WHEN kind IN (16, 18) THEN a + 1
      WHEN kind IN (5, 8) THEN a + 2 WHEN NOT entering THEN result WHEN kind = 0 THEN a WHEN kind IN (4, 7, 15) THEN a + 2
      WHEN kind = 13 THEN a + 5 ELSE 0 END AS base,
    CASE WHEN kind IN (9, 10, 11, 17) THEN NULL WHEN kind IN (1, 14) THEN a WHEN kind IN (4, 5, 7, 8, 15) THEN a + 2 WHEN kind = 13 THEN a + 5
      WHEN kind IN (16, 18) THEN a + 1 ELSE 0 END AS previous,
    CASE WHEN kind IN (9, 10, 11, 17) THEN NULL WHEN kind IN (0, 1, 2) THEN a + 1 WHEN kind IN (3, 6) THEN a + 2 WHEN kind IN (4, 7) THEN a + 3
      WHEN kind IN (12, 13, 15) THEN a + 4 ELSE 0 END AS bytes,
    CASE WHEN kind IN (9, 10, 11, 17) THEN NULL WHEN kind = 0 THEN a + 3 WHEN kind IN (2, 16) THEN a + 2 WHEN kind IN (12, 13) THEN a + 1
      WHEN kind = 15 THEN a + 6 ELSE 0 END AS api_protection,
    NOT entering AND (kind IN (9, 10, 11, 17, 18) OR result <> 0) AS api_succeeded FROM x""")
def interpret_memory_api(spark, sf):
    """Line items as raw routine calls; pointer-passing routines have no recorded values here (null)."""
    none = "CAST(NULL AS DECIMAL(20,0))"
    rows = t.read(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey % 19 AS api_kind", "l_suppkey % 2 = 0 AS entering",
        "CAST(CAST(l_quantity AS BIGINT) % 5 AS DECIMAL(20,0)) AS result",
        *[f"CAST(l_orderkey + {i} AS DECIMAL(20,0)) AS arg{i}" for i in range(12)],
        f"{none} AS base_address", f"{none} AS previous_address", f"{none} AS size", f"{none} AS protection")
    names = ["base", "previous", "bytes", "api_protection"]
    return big(memory_api.interpret(rows), *names).select(
        "l_orderkey", "l_linenumber", F.col("api_kind").alias("kind"), *names, "api_succeeded")


@query("thread_lifetimes", duck("ev") + """ SELECT tid, tid + 100 AS os_tid, min(CASE WHEN k % 2 = 0 THEN seq END) AS start_seq,
  max(CASE WHEN k % 2 = 1 THEN seq END) AS finish_seq, max(CASE WHEN k % 2 = 1 THEN ns END) - min(CASE WHEN k % 2 = 0 THEN ns END)
  AS lifetime_ns FROM ev WHERE kind = 9 GROUP BY tid""")
def thread_lifetimes(spark, sf):
    return calls.thread_lifetimes(t.typed_tables(spark, sf)["thread_events"]).drop("run_id")
