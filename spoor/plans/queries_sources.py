"""Queries: text recordings, prepared tables, several runs, provenance, streams."""

from pyspark.sql import functions as F

from spoor import schemas
from spoor.functions import bytes as B
from spoor.operators import evidence, search, timeline
from spoor.plans import recordings
from spoor.plans import tables as t
from spoor.plans.queries_timeline import EVIDENCE_SQL, shown
from spoor.plans.registry import ORACLES, query
from spoor.plans.tables import duck
from spoor.session import scratch_path
from spoor.sources import catalog, container, csv_run, prepared, recording
from spoor.streaming import live


@query("csv_round_trip", EVIDENCE_SQL)
def csv_round_trip(spark, sf):
    """A whole recording written as CSV and read back; dynamic rows as evidence."""
    path = scratch_path(spark, "csv-run")
    csv_run.write_csv_run(t.all_tables(spark, sf), path)
    back = csv_run.read_csv_run(spark, path)
    dynamic = {n: df for n, df in back.items() if "sequence" in df.columns and n != "modules"}
    return shown(evidence.to_evidence(dynamic))


def _decoded(records):
    """The dynamic records of binary recordings as evidence."""
    rows = records.withColumn("run_id", F.lit(1).cast("bigint"))
    kinds = [kind for kind, name in schemas.NAMES.items() if any(n == "sequence" for n, _ in schemas.fields(kind)) and name != "modules"]
    return shown(evidence.to_evidence({schemas.NAMES[kind]: container.decode_records(rows, kind) for kind in kinds}))


@query("container_round_trip", EVIDENCE_SQL)
def container_round_trip(spark, sf):
    """A whole recording written as binary files and read back through the data source."""
    return _decoded(recording.read_by_type(spark, recordings.write_recordings(spark, sf), scratch_path(spark, "records")))


@query("streamed_container", EVIDENCE_SQL)
def streamed_container(spark, sf):
    """The same files as a stream of records that is stored as it arrives."""
    return _decoded(_finished(spark, recording.stream(spark, recordings.write_recordings(spark, sf)), "stream-records"))


@query("container_audit", duck("ev") + """ SELECT seq // 16384 AS file, CAST((count(*) + 999) // 1000 AS BIGINT) AS blocks,
  CAST(count(*) AS BIGINT) AS records, true AS sound FROM ev GROUP BY 1""")
def container_audit(spark, sf):
    """Blocks and records of every file of events, each block's checksum, envelopes and count verified."""
    paths = recordings.write_recordings(spark, sf)
    rows = container.audit_blocks(spark, paths).withColumn("file", F.regexp_extract("path", r"(\d+)\.jkt$", 1).cast("bigint"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("blocks"), F.sum("records").alias("records"),
                                    F.bool_and(F.col("status") == "Block").alias("sound"))


@query("csv_round_trip_text", """SELECT p_partkey + 1 AS iid, p_brand AS routine, p_name || ', "' || p_brand || '"' || chr(10) || ';'
  AS disassembly, substr(md5(p_name), 1, 8) AS code FROM part""")
def csv_round_trip_text(spark, sf):
    """Quotes, commas and line breaks inside text fields survive."""
    path = scratch_path(spark, "csv-text")
    name = "instruction_definitions"
    csv_run.write_csv_run({name: t.all_tables(spark, sf)[name]}, path)
    back = csv_run.typed(csv_run.read_text_dataset(spark, f"{path}/{name}.csv", 3), 3)
    return back.select(F.col("instruction_id").alias("iid"), "routine", "disassembly", B.hex_text("encoding_hex").alias("code"))


@query("csv_violations", """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'sequence' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'memory_address' END, CASE WHEN o_custkey % 4 = 0 THEN 'multi_element' END,
  CASE WHEN o_orderstatus = 'P' THEN 'requested_size' END, CASE WHEN o_orderpriority IN ('1-URGENT') THEN 'access' END,
  CASE WHEN o_custkey % 9 = 0 THEN 'value_hex' END) AS violations FROM orders""")
def csv_violations(spark, sf):
    """Orders as memory rows in text form, with bad fields that follow from the keys."""
    rows = t.read(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN concat('-', o_orderkey) ELSE CAST(o_orderkey AS STRING) END AS sequence",
        "'0' AS monotonic_ns", "'4294967295' AS thread_id", "'007' AS instruction_id",
        "CASE WHEN o_orderkey % 5 = 0 THEN hex(o_orderkey) ELSE concat('0x', hex(o_orderkey)) END AS memory_address",
        "'0' AS operand_index", "'0' AS element_index", "CASE WHEN o_custkey % 4 = 0 THEN 'TRUE' ELSE 'false' END AS multi_element",
        "CASE WHEN o_orderstatus = 'P' THEN '4294967296' ELSE '8' END AS requested_size",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'read_before' ELSE 'read' END AS access",
        "CASE WHEN o_custkey % 9 = 0 THEN 'abc' ELSE 'AbCd' END AS value_hex")
    return csv_run.csv_violations(rows, 5).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@query("prepared_coverage", duck("ev", "ins") + """ SELECT mid, ev.iid, CAST(count(*) AS BIGINT) AS executions FROM ev JOIN ins ON ev.iid = ins.iid
  WHERE kind = 4 GROUP BY mid, ev.iid""")
def prepared_coverage(spark, sf):
    """A recording prepared, published, opened again; its hot-spot table."""
    return _prepared(spark, sf)["coverage"].select("mid", "iid", "executions")


_places: dict[tuple[str, str], str] = {}


def _prepared(spark, sf):
    """The prepared recording of these tables; an application prepares it once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _places:
        path = scratch_path(spark, "prepared")
        prepared.prepare_run(spark, t.all_tables(spark, sf), path)
        _places[key] = path
    return prepared.open_run(spark, _places[key])


@query("prepared_timeline_page", duck("ev") + """, r AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS ordinal, count(*) OVER () AS total,
    count(*) FILTER (seq < (SELECT max(seq) // 3 FROM ev)) OVER () AS earlier FROM ev WHERE kind IN (5, 6) AND access = 'write_after')
  SELECT seq, ordinal, ordinal // 100 + 1 AS page, total FROM r WHERE ordinal // 100 = least(earlier // 100, (total - 1) // 100)""")
def prepared_timeline_page(spark, sf):
    """A page of writes at a moment, numbered by the stored postings."""
    run = _prepared(spark, sf)
    cursor = t.evidence(spark, sf).agg(F.expr("max(seq) div 3")).first()[0]
    page = timeline.timeline_page_at(run["evidence"], cursor, 100, category="Writes", postings=run["piece_counts"])
    return page.select("seq", "ordinal", F.col("page").cast("bigint").alias("page"), "total")


@query("prepared_memory_history", duck("ev") + """ SELECT seq, tid, access FROM ev WHERE kind = 5 AND access <> 'prefetch'
  AND addr < 24 AND addr + width > 20""")
def prepared_memory_history(spark, sf):
    """Accesses of four bytes, from the samples in the order of their addresses."""
    return prepared.memory_history(_prepared(spark, sf), 20, 4, 1 << 60).select("seq", "tid", "access")


@query("prepared_value_search", duck("ev") + """ SELECT seq, kind FROM ev WHERE kind IN (5, 6) AND access <> 'prefetch' AND contains(hex, 'e4da3b')
  AND regexp_matches(hex, '^(?:..)*?e4da3b')""")
def prepared_value_search(spark, sf):
    """Three bytes, found through the gram index of the preparation."""
    run = _prepared(spark, sf)
    hits = search.search_values(run["evidence"], run["instructions"], run["registers"], search.alternatives("e4 da 3b", "HEX"),
                                index=run["value_grams"])
    return hits.select("seq", "kind")


@query("load_runs", duck("evr") + """ SELECT CASE run_id WHEN 1 THEN 'click' WHEN 2 THEN 'error' WHEN 3 THEN 'purchase'
  WHEN 4 THEN 'signup' ELSE 'view' END AS label, kind, CAST(count(*) AS BIGINT) AS events FROM evr GROUP BY ALL""")
def load_runs(spark, sf):
    """Five recordings, one per event type, with all their record types, loaded as one."""
    tables = t.typed_tables(spark, sf, runs=True)
    runs = [(label, {n: df.filter(F.col("run_id") == i) for n, df in tables.items()}) for i, label in enumerate(t.RUNS, 1)]
    merged, labels = prepared.load_runs(runs)
    rows = evidence.to_evidence(merged).groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("events"))
    return rows.join(labels, "run_id").select("label", "kind", "events")


@query("prepared_snapshots", duck("evr") + """, v AS (SELECT 1 AS version, * FROM evr WHERE run_id <= 3 UNION ALL SELECT 2, * FROM evr)
  SELECT version, run_id, kind, CAST(count(*) AS BIGINT) AS events, CAST(sum(seq) AS BIGINT) AS total FROM v GROUP BY ALL""")
def prepared_snapshots(spark, sf):
    """Three runs prepared, then two more added after an attempt that broke; both versions, the first one opened before."""
    path, dynamic = scratch_path(spark, "prepared"), t.typed_tables(spark, sf, runs=True)
    static = {n: df for n, df in t.all_tables(spark, sf).items() if n not in dynamic}

    def part(*runs):
        own = F.explode(F.array(*(F.lit(r).cast("bigint") for r in runs)))
        return {n: df.withColumn("run_id", own) for n, df in static.items()} | {n: df.filter(F.col("run_id").isin(*runs)) for n, df in dynamic.items()}

    def broken():
        raise InterruptedError("before publishing")

    first = prepared.prepare_run(spark, part(1, 2, 3), path)
    opened = {first: prepared.open_run(spark, path)["evidence"]}
    try:
        prepared.prepare_run(spark, part(4, 5), path, before_publish=broken)
    except InterruptedError:
        second = prepared.prepare_run(spark, part(4, 5), path)
        opened[second] = prepared.open_run(spark, path)["evidence"]
    counted = [df.filter("kind NOT IN (1, 2, 3, 10, 14, 16)").groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("events"), F.sum("seq").alias("total")).withColumn("version", F.lit(v))
               for v, df in opened.items()]
    return counted[0].unionByName(counted[1])


@query("source_provenance")
def source_provenance(spark, sf):
    """The given tables' own files."""
    return catalog.source_provenance(spark, [sf])


# --- streams -------------------------------------------------------------------------------------------

_MINUTE = 60 * 10**9


def _landed(spark, sf, ended=True):
    """The events as evidence files in a folder of their own."""
    path, rows = scratch_path(spark, "landed"), t.evidence(spark, sf).select(schemas.EVIDENCE.fieldNames())
    rows.repartitionByRange(8, "seq").write.parquet(path)
    if ended:
        live.land_end(rows, path, _MINUTE)
    return path


def _starts(spark, sf):
    first = t.evidence(spark, sf).groupBy("run_id").agg(F.expr("min(ns) div 1000000000").alias("unix_timestamp"))
    return first.withColumn("start_ns", F.col("unix_timestamp") * 1000000000)


def _finished(spark, stream, name):
    """Runs a stream over all landed files and returns what it appended."""
    out = scratch_path(spark, name)
    run = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state")
           .trigger(availableNow=True).start(out))
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("streaming_time_profile", duck("ev") + """ SELECT ns // 1000000000 AS second, CAST(count(*) AS BIGINT) AS events,
  CAST(count(*) FILTER (kind = 4) AS BIGINT) AS instructions, CAST(count(*) FILTER (kind = 15) AS BIGINT) AS memory_api
  FROM ev GROUP BY 1""")
def streaming_time_profile(spark, sf):
    """Every second of a finished recording; the watermark is one minute behind."""
    timed = live.with_event_time(live.stream_events(spark, _landed(spark, sf)), _starts(spark, sf), "1 minute")
    rows = _finished(spark, live.time_profile(timed), "stream-profile")
    return rows.withColumn("second", F.unix_seconds("second")).drop("run_id")


@query("streaming_duplicate_guard", duck("ev") + " SELECT seq, kind FROM ev")
def streaming_duplicate_guard(spark, sf):
    """Every event arrives twice."""
    path, starts = _landed(spark, sf, ended=False), _starts(spark, sf)
    twice = live.stream_events(spark, path).unionByName(live.stream_events(spark, path))
    timed = live.with_event_time(twice, starts, "1 day")
    return _finished(spark, live.drop_duplicates(timed).select("seq", "kind"), "stream-unique")


def _two_deliveries(spark, sf, *columns):
    """Stack rows of the whole recording, delivered as an earlier and a later set of files."""
    rows = t.event_rows(spark, sf).selectExpr("1L AS run_id", "tid", "seq", "ns", *columns).filter("kind IS NOT NULL")
    middle = rows.agg(F.expr("max(seq) div 2")).first()[0]
    path = scratch_path(spark, "delivered")
    for part in (rows.filter(F.col("seq") <= middle), rows.filter(F.col("seq") > middle)):
        part.repartition(8).write.mode("append").parquet(path)
    live.land_end(rows, path, _MINUTE)
    stream = live.land(spark, path, rows.schema, files_per_trigger=8)
    return stream.withColumn("event_time", F.timestamp_micros(F.expr("ns div 1000"))).withWatermark("event_time", "1 minute")


@query("streaming_correlate_calls", ORACLES["correlate_calls"])
def streaming_correlate_calls(spark, sf):
    """Call/return matching while files land."""
    timed = _two_deliveries(spark, sf, "CASE WHEN kind IN (7, 8) THEN kind END AS kind", "grp AS call_id",
                            "CASE kind WHEN 7 THEN 4096 + k % 5 ELSE 4096 + k % 7 END AS address")
    return _finished(spark, live.correlate_calls(timed), "stream-calls").drop("run_id")


@query("streaming_correlate_syscalls", ORACLES["correlate_syscalls"].replace(
    "SELECT tid, seq, entering, epoch, CASE WHEN NOT entering AND NOT orphan THEN opened END AS enter_seq FROM p",
    "SELECT tid, seq, entering, CASE WHEN entering THEN seq WHEN NOT orphan THEN opened ELSE 0 END AS enter_seq FROM p"))
def streaming_correlate_syscalls(spark, sf):
    timed = _two_deliveries(spark, sf, "CASE WHEN kind = 13 THEN 13 WHEN k % 2 = 0 THEN 1 ELSE 0 END AS kind",
                            "seq AS call_id", "0L AS address")
    rows = _finished(spark, live.correlate_syscalls(timed), "stream-syscalls").filter("kind <> 13")
    return rows.select("tid", "seq", (F.col("kind") == 1).alias("entering"), F.col("call_id").alias("enter_seq"))
