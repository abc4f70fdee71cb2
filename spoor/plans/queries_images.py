"""Queries: modules, images, code identity, run comparison, process trees."""

from pyspark.sql import functions as F

from spoor.functions import bytes as B
from spoor.functions import text as X
from spoor.operators import coverage, images
from spoor.plans import tables as t
from spoor.plans.registry import big, query
from spoor.plans.tables import duck


@query("module_lifetimes", duck("mods") + """ SELECT module_id, CAST(load_seq AS BIGINT) AS load_seq, CAST(unload_seq AS BIGINT) AS unload_seq,
  base, size AS mapped_size FROM mods""")
def module_lifetimes(spark, sf):
    rows = images.module_lifetimes(t.modules(spark, sf))
    return big(rows, "base", "mapped_size", "load_seq", "unload_seq").select(
        "module_id", "load_seq", "unload_seq", "base", "mapped_size")


@query("rva_map", duck("mods") + """ SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey * 50 < size THEN base + l_partkey * 50 END AS runtime
  FROM lineitem LEFT JOIN mods ON module_id = l_suppkey + 1""")
def rva_map(spark, sf):
    points = t.read(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "1L AS run_id", "l_suppkey + 1 AS module_id",
        "CAST(5368709120 + l_partkey * 50 AS DECIMAL(20,0)) AS address", "CAST(5368709120 AS DECIMAL(20,0)) AS image_base")
    return big(images.rva_map(points, t.modules(spark, sf)), "runtime").select("l_orderkey", "l_linenumber", "runtime")


@query("program_map", duck("ins") + " SELECT iid, 4194304 * mid + off AS program_address FROM ins")
def program_map(spark, sf):
    ins = t.instructions(spark, sf)
    programs = ins.select("run_id", F.col("mid").alias("module_id")).distinct().withColumn(
        "image_base", (F.col("module_id") * 4194304).cast(B.U64))
    return big(images.program_map(ins, programs), "program_address").select("iid", "program_address")


_POINT = "o_orderkey + 1 AS seq, o_custkey {div} 3 * 16384 + o_orderkey * 37 AS addr"


@query("attribute_module", duck("mods") + f""", p AS (SELECT {_POINT.format(div='//')} FROM orders),
  hit AS (SELECT seq, module_id, addr - base AS off FROM p JOIN mods ON addr >= base AND addr < base + size AND seq >= load_seq
    WHERE unload_seq IS NULL OR seq < unload_seq)
  SELECT seq, coalesce(module_id, 0) AS module_id, coalesce(off, addr) AS module_offset FROM p LEFT JOIN hit USING (seq)""")
def attribute_module(spark, sf):
    points = t.read(spark, sf, "orders").selectExpr("1L AS run_id", *_POINT.format(div="div").split(", ")).withColumn(
        "addr", F.col("addr").cast(B.U64))
    rows = images.attribute_module(points, images.module_lifetimes(t.modules(spark, sf)))
    return big(rows, "module_offset").select("seq", "module_id", "module_offset")


@query("attribute_function", duck("ev") + """, f AS (SELECT p_size AS address, p_partkey + 1 AS function_id, p_partkey // 2 * 3 + 1 AS load_seq FROM part)
  SELECT ev.seq, coalesce(arg_max(function_id, load_seq * 1000000000 + function_id), 0) AS function_id FROM ev
  LEFT JOIN f ON address = target AND load_seq <= seq WHERE kind = 7 GROUP BY ev.seq""")
def attribute_function(spark, sf):
    functions = t.read(spark, sf, "part").selectExpr(
        "1L AS run_id", "CAST(p_size AS DECIMAL(20,0)) AS address", "p_partkey + 1 AS function_id",
        "p_partkey div 2 * 3 + 1 AS seq")
    events = t.evidence(spark, sf).filter("kind = 7").select("run_id", "seq", "target", "tid")
    return images.attribute_function(events, functions).select("seq", "function_id")


@query("code_identity", """WITH d AS (SELECT l_suppkey AS address, l_linenumber % 2 AS module_id, l_returnflag AS code, l_quantity::BIGINT % 2 AS size,
    row_number() OVER (ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice) AS seq FROM lineitem),
  c AS (SELECT *, lag(module_id || code || size) OVER k IS DISTINCT FROM module_id || code || size AS created FROM d
    WINDOW k AS (PARTITION BY address ORDER BY seq)),
  n AS (SELECT *, CAST(sum(created::INT) OVER (ORDER BY seq) AS BIGINT) AS id FROM c)
  SELECT address, seq, created, last_value(CASE WHEN created THEN id END IGNORE NULLS) OVER (PARTITION BY address ORDER BY seq) AS instruction_id
  FROM n""")
def code_identity(spark, sf):
    """Line items as definition requests; the supplier is the address."""
    rows = t.read(spark, sf, "lineitem").selectExpr(
        "1L AS run_id", "l_suppkey AS address", "CAST(l_linenumber % 2 AS BIGINT) AS module_id", "l_orderkey",
        "l_partkey", "l_linenumber", "l_extendedprice", "CAST(l_quantity AS BIGINT) % 2 AS size",
        "CAST(l_returnflag AS BINARY) AS encoding")
    rows = images.code_identity(rows, 4096, order="l_orderkey", tie=("l_partkey", "l_linenumber", "l_extendedprice"), ordinal="seq")
    return rows.select("address", F.expr("seq + 1").alias("seq"), "created", "instruction_id")


def _le(number: str, width: int) -> str:
    """SQL: little-endian hex text of a number."""
    text = f"lpad(hex({number}), {2 * width}, '0')"
    return "concat(" + ", ".join(f"substr({text}, {2 * i + 1}, 2)" for i in reversed(range(width))) + ")"


def _headers(spark, sf):
    """Parts as small executable images; some with a wrong signature, magic or length."""
    coff = ["'50450000'", _le("34404", 2), "'0000'", _le("1000000 + p_partkey", 4), "'0000000000000000'",
            _le("CASE WHEN p_size % 5 = 3 THEN 60 ELSE 240 END", 2), "'0000'"]
    optional = [_le("CASE WHEN p_size % 5 = 2 THEN 263 ELSE 523 END", 2), "repeat('00', 14)", _le("p_partkey * 16", 4),
                "repeat('00', 36)", _le("p_size * 4096", 4), "'00000000'", _le("p_partkey * 3", 4), "repeat('00', 40)"]
    start = "concat(CASE WHEN p_size % 5 = 1 THEN '4D5B' ELSE '4D5A' END, repeat('00', 58), '40000000')"
    image = f"concat({start}, {', '.join(coff + optional)})"
    return t.read(spark, sf, "part").selectExpr(
        "p_partkey", "p_size", f"unhex(substr({image}, 1, CASE WHEN p_size % 5 = 4 THEN 200 ELSE 1000 END)) AS content")


@query("pe_identities", """SELECT p_partkey, p_size % 5 = 0 AS pe_identity_valid, CAST(CASE p_size % 5 WHEN 0 THEN 34404 ELSE 0 END AS BIGINT) AS machine,
  CASE p_size % 5 WHEN 0 THEN 1000000 + p_partkey ELSE 0 END AS pe_timestamp, CASE p_size % 5 WHEN 0 THEN p_partkey * 3 ELSE 0 END AS pe_checksum,
  CAST(CASE p_size % 5 WHEN 0 THEN p_size * 4096 ELSE 0 END AS BIGINT) AS declared_image_size, CASE p_size % 5 WHEN 0 THEN p_partkey * 16 ELSE 0 END
  AS entry_point_rva FROM part""")
def pe_identities(spark, sf):
    return images.pe_identities(_headers(spark, sf)).drop("p_size", "content")


@query("module_identity_problem", """SELECT p_partkey + 1 AS module_id, CASE WHEN p_partkey % 11 = 0 THEN
  'not_recorded'
  WHEN p_size % 5 = 1 THEN 'no_image'
  WHEN p_partkey % 7 = 0 THEN 'pe_timestamp'
  WHEN p_size % 5 = 2 THEN 'not_64_bit'
  WHEN p_size % 5 = 4 THEN 'unreadable'
  WHEN p_partkey % 13 = 0 THEN 'pe_checksum' END AS problem FROM part""")
def module_identity_problem(spark, sf):
    headers = _headers(spark, sf)
    programs = headers.selectExpr("1L AS run_id", "p_partkey + 1 AS module_id", "content")
    modules = headers.selectExpr(
        "1L AS run_id", "p_partkey + 1 AS module_id", "true AS loaded", "p_partkey % 11 <> 0 AS pe_identity_valid",
        "34404L AS machine", "1000000 + p_partkey + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS pe_timestamp",
        "p_partkey * 3 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS pe_checksum",
        "p_size * 4096L AS declared_image_size", "p_partkey * 16 AS entry_point_rva")
    return images.module_identity_problem(modules, programs).drop("run_id")


_MODR = """, modr AS (SELECT run_id, module_id, s_nationkey, s_name, run_id = 5 AS rebuilt FROM mods, (SELECT unnest(range(1, 6)) AS run_id)
  UNION ALL SELECT 4, module_id + 1000000, s_nationkey, s_name, false FROM mods WHERE s_acctbal < 0)"""


@query("same_image", duck("mods") + _MODR + """ SELECT run_id, lower(s_name) || '.dll' AS image_name, 1700000000 + s_nationkey + rebuilt::INT
  AS pe_timestamp, CAST(count(*) AS BIGINT) AS copies, min(module_id) AS module_id FROM modr WHERE s_nationkey <> 3
  GROUP BY run_id, s_name, s_nationkey, rebuilt""")
def same_image(spark, sf):
    return coverage.same_image(t.modules(spark, sf, 5)).select("run_id", "image_name", "pe_timestamp", "copies", "module_id")


@query("compare_runs", duck("evr", "ins", "mods") + _MODR + """, pick AS (SELECT s_name FROM mods WHERE module_id = 3 AND s_nationkey <> 3),
  one AS (SELECT run_id, count(*) AS copies FROM modr WHERE s_name IN (SELECT s_name FROM pick) AND NOT rebuilt GROUP BY run_id),
  n AS (SELECT run_id, count(*) AS executions FROM evr WHERE kind = 4 AND iid IN (SELECT iid FROM ins WHERE mid = 3 AND off = 32) GROUP BY run_id)
  SELECT r.run_id, CASE WHEN copies = 1 THEN 'compared' ELSE 'no single match' END AS status,
    CASE WHEN copies = 1 THEN coalesce(executions, 0) END AS executions FROM (SELECT unnest(range(1, 6)) AS run_id) r
    LEFT JOIN one USING (run_id) LEFT JOIN n USING (run_id)""")
def compare_runs(spark, sf):
    counts, _ = coverage.compare_runs(t.evidence(spark, sf, runs=True), t.instructions(spark, sf, 5),
                                      t.modules(spark, sf, 5), 1, 3, 32)
    return counts


@query("compare_runs_events", duck("evr", "ins", "mods") + _MODR + """, pick AS (SELECT s_name FROM mods WHERE module_id = 3 AND s_nationkey <> 3),
  one AS (SELECT run_id, count(*) AS copies FROM modr WHERE s_name IN (SELECT s_name FROM pick) AND NOT rebuilt GROUP BY run_id)
  SELECT run_id, seq, kind FROM evr JOIN one USING (run_id) WHERE copies = 1 AND iid IN (SELECT iid FROM ins WHERE mid = 3 AND off = 32)""")
def compare_runs_events(spark, sf):
    _, events = coverage.compare_runs(t.evidence(spark, sf, runs=True), t.instructions(spark, sf, 5),
                                      t.modules(spark, sf, 5), 1, 3, 32)
    return events.select("run_id", "seq", "kind")


@query("compare_offsets", duck("evr", "ins", "mods") + _MODR + """, u AS (SELECT run_id, s_name, s_nationkey, rebuilt, min(module_id) AS mid FROM modr
    WHERE s_nationkey <> 3 GROUP BY ALL HAVING count(*) = 1),
  n AS (SELECT run_id, iid, count(*) AS n FROM evr WHERE kind = 4 GROUP BY ALL)
  SELECT u.run_id, lower(s_name) || '.dll' AS image_name, off, CAST(sum(coalesce(n, 0)) AS BIGINT) AS executions
  FROM u JOIN ins ON ins.mid = u.mid LEFT JOIN n ON n.run_id = u.run_id AND n.iid = ins.iid GROUP BY ALL""")
def compare_offsets(spark, sf):
    ev = t.evidence(spark, sf, runs=True)
    rows = coverage.compare_offsets(coverage.execution_counts(ev), t.instructions(spark, sf, 5), t.modules(spark, sf, 5))
    return big(rows, "off").select("run_id", "image_name", "off", "executions")


@query("code_bytes_differ", duck("ins") + """ SELECT a.mid AS image, a.off, a.encoding AS left_code, b.encoding AS right_code FROM ins a JOIN ins b
  ON a.mid = b.mid AND a.off = b.off AND a.iid % 2 = 0 AND b.iid % 2 = 1 WHERE a.encoding <> b.encoding""")
def code_bytes_differ(spark, sf):
    """The two code revisions of every offset, as two builds of an image."""
    ins = t.instructions(spark, sf).withColumn("image_name", F.col("mid").cast("string"))
    rows = coverage.code_bytes_differ(ins.filter("iid % 2 = 0"), ins.filter("iid % 2 = 1"))
    return rows.select(F.col("image_name").cast("bigint").alias("image"), F.col("off").cast("bigint").alias("off"),
                       B.hex_text("left_code").alias("left_code"), B.hex_text("right_code").alias("right_code"))


@query("process_edges", """SELECT c_custkey + 1 AS process_id, (c_custkey + 1) // 2 AS parent_process_id, c_custkey > 0 AND c_acctbal > 0 AS followed,
  CAST(c_nationkey AS BIGINT) AS exit_code, c_name AS command_line FROM customer""")
def process_edges(spark, sf):
    return big(images.process_edges(t.processes(spark, sf)), "exit_code").select(
        "process_id", "parent_process_id", "followed", "exit_code", "command_line")


@query("process_tree", """WITH RECURSIVE p AS (SELECT c_custkey + 1 AS process_id, (c_custkey + 1) // 2 AS parent FROM customer),
  r AS (SELECT process_id, process_id AS root, CAST(0 AS BIGINT) AS depth FROM p WHERE parent NOT IN (SELECT process_id FROM p)
    UNION ALL SELECT p.process_id, r.root, r.depth + 1 FROM p JOIN r ON p.parent = r.process_id)
  SELECT process_id, root, depth FROM r""")
def process_tree(spark, sf):
    return images.process_tree(images.process_edges(t.processes(spark, sf))).select("process_id", "root", "depth")


@query("process_tree_reused", """WITH RECURSIVE c AS (SELECT c_custkey AS n FROM customer),
  p AS (SELECT a.n, max(b.n) AS up FROM c a LEFT JOIN c b ON b.n % 700 = (a.n // 2) % 700 AND b.n < a.n AND (a.n // 2) % 700 <> a.n % 700 GROUP BY a.n),
  r AS (SELECT n, n AS root, CAST(0 AS BIGINT) AS depth FROM p WHERE up IS NULL
    UNION ALL SELECT p.n, r.root, r.depth + 1 FROM p JOIN r ON p.up = r.n)
  SELECT n + 1 AS life, n % 700 + 1 AS process_id, root % 700 + 1 AS root, depth, false AS cycle FROM r""")
def process_tree_reused(spark, sf):
    """Process ids that are used again: a parent is the life of its id that was current at the start."""
    rows = images.process_tree(images.process_edges(t.reused_processes(spark, sf)))
    return rows.select("life", "process_id", "root", "depth", "cycle")


@query("unsigned_numbers", """SELECT l_orderkey, l_linenumber, '0x' || printf('%x', l_partkey) AS hex,
  CAST(l_partkey AS BIGINT) AS parsed FROM lineitem""")
def unsigned_numbers(spark, sf):
    rows = t.read(spark, sf, "lineitem").withColumn("hex", B.hex_address(F.col("l_partkey").cast(B.U64)))
    return rows.select("l_orderkey", "l_linenumber", "hex", B.parse_unsigned("hex").cast("bigint").alias("parsed"))


@query("little_endian", """SELECT o_orderkey, (o_orderkey * 65536 + 250 - o_custkey % 250) AS plain,
  CASE WHEN o_custkey % 250 < 250 AND 250 - o_custkey % 250 >= 128 THEN 250 - o_custkey % 250 - 256 ELSE 250 - o_custkey % 250 END AS low_signed
  FROM orders""")
def little_endian(spark, sf):
    number = "o_orderkey * 65536 + 250 - o_custkey % 250"
    rows = t.read(spark, sf, "orders").selectExpr("o_orderkey", f"unhex({_le(number, 8)}) AS raw")
    return rows.select("o_orderkey", B.little_unsigned("raw").cast("bigint").alias("plain"),
                       B.little_signed(F.substring("raw", 1, 1)).cast("bigint").alias("low_signed"))


@query("join_arguments", """SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN '""' ELSE c_name END || ' ' ||
  CASE WHEN contains(seg, ' ') OR contains(seg, '"') THEN '"' || replace(replace(seg, '\\', '\\\\'), '"', '\\"') || '"' ELSE seg END AS command_line
  FROM (SELECT *, CASE c_nationkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'a "' || c_mktsegment || '" \\b' ELSE 'c:\\' || c_mktsegment END AS seg FROM customer)""")
def join_arguments(spark, sf):
    rows = t.read(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_name END AS first",
        "CASE c_nationkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN concat('a \"', c_mktsegment, '\" ', chr(92), 'b') "
        "ELSE concat('c:', chr(92), c_mktsegment) END AS second")
    return rows.select("c_custkey", X.join_arguments(F.array("first", "second")).alias("command_line"))


@query("format_bytes", """SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0)
  WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0) ELSE printf('%.2f GiB', b / 1073741824.0) END AS shown
  FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 1024 + o_orderkey AS b FROM orders)""")
def format_bytes(spark, sf):
    return t.read(spark, sf, "orders").select("o_orderkey", X.format_bytes(
        F.expr("o_orderkey * o_orderkey * 1024 + o_orderkey")).alias("shown"))
