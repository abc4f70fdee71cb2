"""Queries: value, change and detail search, gram index."""

from pyspark.sql import functions as F

from spoor.operators import evidence, search
from spoor.operators.search import Scope, alternatives
from spoor.plans import tables as t
from spoor.plans.registry import query
from spoor.plans.tables import duck
from spoor.session import scratch_path


def _documents(spark, sf, patterns, scope=Scope()):
    docs = t.document_samples(spark, sf)
    return search.search_values(docs, t.instructions(spark, sf), _registers(spark, sf), patterns, scope)


def _registers(spark, sf):
    return evidence.register_catalog(t.registers(spark, sf))


def _offset(text: str, needle: str) -> str:
    """Byte offset of the first occurrence (DuckDB positions count characters)."""
    return f"strlen(substr({text}, 1, instr({text}, '{needle}') - 1))"


@query("value_search", duck("docs") + f""" SELECT seq, addr, 'UTF8' AS encoding, {_offset('text', 'the')} AS offset
  FROM docs WHERE contains(text, 'the')""")
def value_search(spark, sf):
    """Whole texts as samples, case-sensitive."""
    hits = _documents(spark, sf, alternatives("the"))
    return hits.select("seq", F.col("addr").cast("bigint").alias("addr"), "encoding", "offset")


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("value_search_folded", duck("docs") + f""" SELECT seq, {_offset('low', 'ion on')} AS offset FROM
  (SELECT *, {_FOLD} AS low FROM docs) WHERE contains(low, 'ion on')""")
def value_search_folded(spark, sf):
    """ASCII case folding."""
    return _documents(spark, sf, alternatives("ION on", "UTF8", ignore_case=True)).select("seq", "offset")


@query("value_search_dictionary", duck("docs", "ins") + f""" SELECT seq, iid, {_offset('text', 'er')} AS offset FROM docs
  WHERE contains(text, 'er') AND iid IN (SELECT iid FROM ins WHERE contains(lower(routine), 'brand#1')
  AND contains(lower(disassembly), 're'))""")
def value_search_dictionary(spark, sf):
    hits = _documents(spark, sf, alternatives("er", "UTF8"), Scope(routine="BRAND#1", disassembly="re"))
    return hits.select("seq", "iid", "offset")


@query("dictionary_filter", duck("ins") + """ SELECT iid, routine, disassembly FROM ins
  WHERE contains(lower(routine), 'brand#2') AND contains(lower(disassembly), 'wi')""")
def dictionary_filter(spark, sf):
    return search.dictionary_filter(t.instructions(spark, sf), "Brand#2", "Wi").select("iid", "routine", "disassembly")


@query("value_search_range", duck("docs") + """, z AS (SELECT seq, addr, greatest(0, 3000 - addr) AS low, hex FROM docs
    WHERE addr <= 6000 AND addr + length(hex) // 2 > 3000),
  f AS (SELECT seq, low, addr, substr(hex, 2 * low + 1) AS tail FROM z),
  g AS (SELECT seq, addr, low, CASE WHEN regexp_matches(tail, '^(?:..)*?6520') THEN
    length(regexp_extract(tail, '^((?:..)*?)6520', 1)) // 2 + low END AS offset FROM f)
  SELECT seq, "offset" FROM g WHERE "offset" IS NOT NULL AND addr + "offset" <= 6000""")
def value_search_range(spark, sf):
    """First match inside an address range, which may start in the middle of a sample."""
    return _documents(spark, sf, alternatives("e ", "UTF8"), Scope(lowest=3000, highest=6000)).select("seq", "offset")


@query("hex_wildcard_search", duck("docs") + """ SELECT seq, length(regexp_extract(hex, '^((?:..)*?)7468..2065', 1)) // 2 AS offset
  FROM docs WHERE regexp_matches(hex, '^(?:..)*?7468..2065')""")
def hex_wildcard_search(spark, sf):
    return _documents(spark, sf, alternatives("74 68 ?? 20 65", "HEX")).select("seq", "offset")


@query("register_value_search", duck("ev") + """, h AS (SELECT *, length(regexp_extract(hex, '^((?:..)*?)' || '1f', 1)) // 2 AS offset
    FROM ev WHERE kind = 6 AND regexp_matches(hex, '^(?:..)*?1f'))
  SELECT seq, CASE reg WHEN 1 THEN 'rax' WHEN 2 THEN 'rbx' WHEN 3 THEN 'rcx' ELSE 'register #' || reg END || ' +' || "offset"
  || ' (thread ' || tid || ')' AS storage FROM h""")
def register_value_search(spark, sf):
    """One byte in any register sample, with storage labels."""
    names = _registers(spark, sf)
    hits = search.search_values(t.evidence(spark, sf), t.instructions(spark, sf), names, alternatives("1F", "HEX"), Scope(kinds=(6,)))
    return search.storage_label(hits, names).select("seq", "storage")


@query("named_register_search", duck("ev") + """ SELECT seq, length(regexp_extract(hex, '^((?:..)*?)' || '1f', 1)) // 2 AS offset
    FROM ev WHERE kind = 6 AND reg = 3 AND access = 'write_after' AND regexp_matches(hex, '^(?:..)*?1f')""")
def named_register_search(spark, sf):
    scope = Scope(register="RCX", writes_only=True)
    return search.search_values(t.evidence(spark, sf), t.instructions(spark, sf), _registers(spark, sf),
                                alternatives("1f", "HEX"), scope).select("seq", "offset")


def _pieces(name: str, needle: str, marker: int) -> str:
    """All byte offsets of a needle that cannot overlap itself, from the lengths of the pieces between."""
    n = len(needle.encode())
    return f"""{name} AS (SELECT seq, addr + pos AS place, {marker} AS marker FROM (
    SELECT seq, addr, n, parts, sum(strlen(piece) + {n}) OVER (PARTITION BY seq ORDER BY n) - {n} AS pos FROM (
      SELECT seq, addr, len(string_split(text, '{needle}')) AS parts, unnest(string_split(text, '{needle}')) AS piece,
        unnest(range(len(string_split(text, '{needle}')))) AS n FROM docs)) WHERE n < parts - 1)"""


@query("value_change", duck("docs") + ", " + _pieces("a", "the", 1) + ", " + _pieces("b", "and", 0) + """,
  m AS (SELECT *, lag(marker) OVER k AS p_marker, lag(seq) OVER k AS p_seq FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
    WINDOW k AS (PARTITION BY place ORDER BY seq, marker))
  SELECT p_seq AS before_seq, seq, CAST(place AS BIGINT) AS place FROM m
  WHERE marker = 0 AND p_marker = 1 AND seq - p_seq <= 400""")
def value_change(spark, sf):
    """Places in overlapping whole texts where one word later becomes another."""
    rows = search.in_scope(t.document_samples(spark, sf), t.instructions(spark, sf), _registers(spark, sf), Scope())
    hits = search.change_hits(rows, alternatives("the", "UTF8"), alternatives("and", "UTF8"), max_gap=400)
    return hits.select("before_seq", "seq", (F.col("addr") + F.col("offset")).cast("bigint").alias("place"))


@query("register_value_change", duck("ev") + """, c AS (SELECT seq, tid, reg, unnest(range(length(hex) // 2)) AS pos, hex FROM ev WHERE kind = 6),
  m AS (SELECT seq, tid, reg, pos, substr(hex, 2 * pos + 1, 1) AS nib FROM c WHERE substr(hex, 2 * pos + 1, 2) IN ('0c', 'a8')),
  w AS (SELECT *, lag(nib) OVER k AS p_nib, lag(seq) OVER k AS p_seq FROM m WINDOW k AS (PARTITION BY tid, reg, pos ORDER BY seq))
  SELECT p_seq AS before_seq, seq, pos AS offset FROM w WHERE nib = 'a' AND p_nib = '0'""")
def register_value_change(spark, sf):
    """Register bytes per thread and offset."""
    scope = Scope(kinds=(6,))
    rows = search.in_scope(t.evidence(spark, sf), t.instructions(spark, sf), _registers(spark, sf), scope)
    hits = search.change_hits(rows, alternatives("0c", "HEX"), alternatives("a8", "HEX"), scope, segment=512)
    return hits.select("before_seq", "seq", "offset")


def _details(spark, sf, text, ignore_case=True, scope=Scope()):
    """Over all dynamic record types."""
    ins = t.instructions(spark, sf)
    rows = search.in_scope(evidence.detail_rows(t.typed_tables(spark, sf)), ins, _registers(spark, sf), scope, samples=False)
    return search.detail_hits(rows, ins, text, ignore_case)


@query("detail_search", duck("ev", "ins") + """ SELECT seq, kind FROM ev LEFT JOIN ins ON ev.iid = ins.iid AND ev.iid <> 0
  WHERE contains(lower(coalesce(disassembly, '')), 'ring') OR contains(lower(coalesce(routine, '')), 'ring') OR kind IN (12, 15)""")
def detail_search(spark, sf):
    """In code texts, and in the field name entering of system calls and memory operations."""
    return _details(spark, sf, "RING").select("seq", "kind")


@query("detail_search_field", duck("ev") + """ SELECT seq FROM ev WHERE kind = 18 AND k % 4 = 1""")
def detail_search_field(spark, sf):
    return _details(spark, sf, "reason: memory_capture", False, Scope(category="Capture diagnostics")).select("seq")


@query("multi_run_search", duck("evr") + """ SELECT run_id, seq FROM evr WHERE kind = 5 AND access <> 'prefetch'
  AND regexp_matches(hex, '^(?:..)*?98') ORDER BY run_id DESC, seq LIMIT 700""")
def multi_run_search(spark, sf):
    """Runs in loading order (last first) share one page of 700 results."""
    ev = t.evidence(spark, sf, runs=True)
    order = ev.select("run_id").distinct().withColumn("position", -F.col("run_id"))
    hits = search.search_values(ev, t.instructions(spark, sf, 5), _registers(spark, sf), alternatives("98", "HEX"), Scope(kinds=(5,)))
    return search.ranked(hits, order, 700).select("run_id", "seq")


@query("search_accounting", duck("docs") + """ SELECT CAST(least(count(*) FILTER (contains(text, 'the')), 50) AS BIGINT) AS hits,
  CAST(count(*) AS BIGINT) AS examined, count(*) FILTER (contains(text, 'the')) >= 50 AS limited FROM docs""")
def search_accounting(spark, sf):
    rows = search.in_scope(t.document_samples(spark, sf), t.instructions(spark, sf), _registers(spark, sf), Scope())
    return search.accounting(rows, alternatives("the", "UTF8"), 50)


_PREVIEW = r"""'UTF-8: ' || replace(replace(replace(substr(text, 1, {n}), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""


@query("preview", """SELECT conv_id, turn, rtrim(regexp_replace(substr(lower(hex(encode(text))), 1, 160), '(..)', '\\1 ', 'g'))
  || CASE WHEN strlen(text) > 80 THEN ' ...' ELSE '' END AS hex FROM conversations WHERE strlen(text) > 0""")
def preview(spark, sf):
    rows = t.read(spark, sf, "conversations").filter("octet_length(text) > 0")
    shown = search.preview(F.col("text").cast("binary"), "UINT32_LE")
    return rows.select("conv_id", "turn", F.regexp_extract(shown, r"^(.*?) \| UTF-8: ", 1).alias("hex"))


# --- gram index --------------------------------------------------------------------------------------

_SPAN = 256
_GRAMS = """, g AS (SELECT seq // 256 AS chunk, unnest(list_concat(list_concat(regexp_extract_all(hex, '.{6}'),
    regexp_extract_all(substr(hex, 3), '.{6}')), regexp_extract_all(substr(hex, 5), '.{6}'))) AS gram FROM docs),
  idx AS (SELECT DISTINCT chunk, upper(gram) AS gram FROM g)"""


@query("value_gram_index", duck("docs") + _GRAMS + " SELECT chunk, gram FROM idx")
def value_gram_index(spark, sf):
    return search.value_gram_index(t.document_samples(spark, sf), _SPAN).select("chunk", "gram")


@query("value_chunks", duck("docs") + """ SELECT seq // 256 AS chunk, min(seq) AS first_seq, max(seq) AS last_seq,
  CAST(count(*) AS BIGINT) AS samples FROM docs GROUP BY 1""")
def value_chunks(spark, sf):
    return search.value_chunks(t.document_samples(spark, sf), _SPAN).drop("run_id")


_NEEDLE = "tion the"


@query("candidate_ranges", duck("docs") + _GRAMS + f""", want AS (SELECT DISTINCT upper(substr(lower(hex(encode('{_NEEDLE}'))), 2 * i + 1, 6)) AS gram
    FROM (SELECT unnest(range({len(_NEEDLE) - 2})) AS i)),
  ok AS (SELECT chunk FROM idx JOIN want USING (gram) GROUP BY chunk HAVING count(*) = (SELECT count(*) FROM want)),
  isl AS (SELECT chunk, chunk - row_number() OVER (ORDER BY chunk) AS island FROM ok)
  SELECT greatest(min(chunk) * 256, 100) AS first_seq, (max(chunk) + 1) * 256 - 1 AS last_seq
  FROM isl GROUP BY island""")
def candidate_ranges(spark, sf):
    index = search.value_gram_index(t.document_samples(spark, sf), _SPAN)
    return search.candidate_ranges(index, alternatives(_NEEDLE, "UTF8"), Scope(first=100), _SPAN, segment=2).select("first_seq", "last_seq")


@query("pruned_value_search", duck("docs") + f""" SELECT seq, {_offset('text', _NEEDLE)} AS offset FROM docs
  WHERE contains(text, '{_NEEDLE}')""")
def pruned_value_search(spark, sf):
    """The same hits as without the index, which is written once, as preparation does."""
    docs, path = t.document_samples(spark, sf), scratch_path(spark, "value-grams")
    search.value_gram_index(docs, _SPAN).write.parquet(path)
    return search.search_values(docs, t.instructions(spark, sf), _registers(spark, sf), alternatives(_NEEDLE, "UTF8"),
                                index=spark.read.parquet(path), span=_SPAN).select("seq", "offset")
