"""Prepared recordings: evidence and derived tables as Parquet, published as numbered snapshots.

A prepared folder holds a folder for each table, in it one for each attempt (``part=...``), and ``snapshots``, one small
file for each version, which lists the parts it consists of. Adding runs writes a part of its own and then the next version; nothing that is there is
written again. A version's file is created only if there is none of that name, so of two writers one fails, and an attempt
that breaks leaves unlisted folders that are in nobody's way. Readers keep the version they opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.operators import audit, calls, coverage, evidence, history, search, timeline
from spoor.sources import container, csv_run

TABLES = ["evidence", "memory_by_address", "instructions", "registers", "modules", "execution_counts", "call_lifetimes", "coverage",
          "category_totals", "piece_counts", "value_grams", "run_summary"]
WRITERS = 4      # derived tables that are written at the same time


def source_listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Path, size and modification time of the source files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select("path", "length", "modificationTime")


def _fingerprint(spark: SparkSession, paths: list[str]):
    listing = source_listing(spark, paths)
    row = listing.agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
        F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("mark")).first()
    return row["files"], row["bytes"] or 0, str(row["mark"])


def instruction_dictionary(definitions: DataFrame) -> DataFrame:
    return definitions.select(
        "run_id", F.col("instruction_id").alias("iid"), F.col("module_id").alias("mid"),
        F.col("module_offset").alias("off"), "address", "size", F.col("encoding_hex").alias("encoding"), "routine",
        "disassembly")


def _versions(spark: SparkSession, out: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/snapshots")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _snapshot(spark: SparkSession, out: str, version: int) -> list[dict]:
    """The parts of a version: name, run ids, source paths and their fingerprint; one entry for each addition of runs."""
    text = spark.read.text(f"{out}/snapshots/{version:08d}.json", wholetext=True).first()[0]
    return json.loads(text)["parts"]


def _publish(spark: SparkSession, out: str, version: int, parts: list[dict]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/snapshots/{version:08d}.json")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)      # fails if there is one
    stream.write(bytearray(json.dumps({"version": version, "parts": parts}).encode()))
    stream.close()


def prepare_run(spark: SparkSession, tables: dict[str, DataFrame], out: str, sources: list[str] | None = None,
                incomplete: DataFrame | None = None, before_publish: Callable | None = None) -> int:
    """Adds the runs of ``tables`` to the prepared set below ``out`` and returns the version that has them.

    Evidence is partitioned by run and kind and range-sorted by sequence, so typed filters skip whole
    directories and row groups; Bloom filters on instruction, call and target skip row groups of look-ups by
    these. Memory samples are written once more in the order of their addresses, for look-ups by place.
    Derived tables are built from the written evidence. If ``sources`` changed meanwhile, nothing is published;
    runs that the set has already are refused.
    """
    versions = _versions(spark, out)
    parts = _snapshot(spark, out, versions[-1]) if versions else []
    before = _fingerprint(spark, sources) if sources else (0, 0, "")
    name = f"p{uuid.uuid4().hex}"
    place = lambda table: f"{out}/{table}/part={name}"
    ev = evidence.ingest_strict(evidence.to_evidence(tables))
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("iid", "cid", "target")}
    # Static records all have sequence number 0: the instruction and the address cut them into several tasks.
    (ev.repartitionByRange("run_id", "kind", "seq", "iid", "addr").sortWithinPartitions("run_id", "kind", "seq")
     .write.options(**blooms).partitionBy("run_id", "kind").parquet(place("evidence")))
    ev = spark.read.parquet(place("evidence")).withColumn("run_id", F.col("run_id").cast("bigint"))
    runs = sorted(r.run_id for r in ev.select("run_id").distinct().collect())              # a number a run
    if known := set(runs) & {run for part in parts for run in part["runs"]}:
        raise ValueError(f"Runs that are prepared already: {sorted(known)}")
    if audit.sequence_audit(ev).filter("duplicates > 0").limit(1).count():
        raise ValueError("A sequence number occurs twice")

    def save(table: str, df: DataFrame) -> DataFrame:
        df.write.parquet(place(table))
        return spark.read.schema(df.schema).parquet(place(table))

    def by_address() -> None:
        # A third of all accesses may hit one page: the sequence number cuts hot addresses.
        (ev.filter("kind = 5").repartitionByRange("run_id", "addr", "seq").sortWithinPartitions("run_id", "addr", "seq")
         .write.partitionBy("run_id").parquet(place("memory_by_address")))

    def covered() -> None:
        instructions = save("instructions", instruction_dictionary(tables["instruction_definitions"]))
        save("coverage", coverage.coverage_totals(save("execution_counts", coverage.execution_counts(ev)), instructions))

    # Each reads the written evidence and none needs another, so the small jobs of one fill the gaps of the others.
    work = [by_address, covered, lambda: save("value_grams", search.value_gram_index(ev)),
            lambda: save("call_lifetimes", calls.call_lifetimes(ev)),
            lambda: save("registers", evidence.register_catalog(tables["register_definitions"])),
            lambda: save("run_summary", audit.run_summary(ev, tables["run"], incomplete)),
            lambda: save("category_totals", timeline.category_totals(ev)),
            lambda: save("piece_counts", timeline.piece_counts(ev)), lambda: save("modules", tables["modules"])]
    with ThreadPoolExecutor(WRITERS) as pool:
        for job in [pool.submit(inheritable_thread_target(spark)(write)) for write in work]:
            job.result()
    if before_publish is not None:
        before_publish()
    if sources and _fingerprint(spark, sources) != before:
        raise RuntimeError("The source changed during preparation; nothing was published")
    version = versions[-1] + 1 if versions else 1
    _publish(spark, out, version, [*parts, {"part": name, "runs": runs, "sources": sources or [], "fingerprint": list(before)}])
    return version


def open_run(spark: SparkSession, out: str, sources: list[str] | None = None, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a published version (the newest, if none is named), each one scan over all parts with a run column;
    unpublished preparations are refused, and those that do not belong to the present ``sources``."""
    versions = _versions(spark, out)
    if not versions or version not in (None, *versions):
        raise FileNotFoundError(f"Not a published preparation: {out}")
    parts = _snapshot(spark, out, version or versions[-1])
    if sources:
        told = {path for part in parts for path in part["sources"]}
        if told != set(sources) or any(tuple(part["fingerprint"]) != _fingerprint(spark, part["sources"]) for part in parts):
            raise RuntimeError("The prepared data does not belong to the present source")
    tables = {name: spark.read.option("basePath", f"{out}/{name}").parquet(*(f"{out}/{name}/part={part['part']}" for part in parts)).drop("part")
              for name in TABLES}
    for name in ("evidence", "memory_by_address"):
        tables[name] = tables[name].withColumn("run_id", F.col("run_id").cast("bigint"))
    return tables


def memory_history(run: dict[str, DataFrame], address: int, size: int, cursor: int, *, writes_only: bool = False,
                   limit: int | None = None) -> DataFrame:
    """history.history_memory over a prepared run: the widest access of the summary bounds the addresses that can touch
    the place, so only row groups around it are read."""
    width = run["run_summary"].agg(F.max("max_width")).first()[0] or 0
    return history.history_memory(run["memory_by_address"], address, size, cursor, writes_only=writes_only, limit=limit, max_width=width)


def load_runs(tables: list[tuple[str, dict[str, DataFrame]]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Several recordings as one set of tables: (label, tables) pairs get run ids 1, 2, ... in order."""
    if not tables:
        raise ValueError("No runs given")
    spark = next(iter(tables[0][1].values())).sparkSession
    merged: dict[str, DataFrame] = {}
    for number, (_, parts) in enumerate(tables, 1):
        for name, df in parts.items():
            df = df.withColumn("run_id", F.lit(number).cast("bigint"))
            merged[name] = merged[name].unionByName(df, allowMissingColumns=True) if name in merged else df
    labels = spark.createDataFrame([(i, label) for i, (label, _) in enumerate(tables, 1)], "run_id bigint, label string")
    return merged, labels


def read_runs(spark: SparkSession, paths: list[str], staging: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Recordings of either form as one set of tables, with their labels and whether a tail was cut.

    A container file, or a directory that holds one, is read as binary; other directories as CSV. The
    label is the directory name.
    """
    runs, cut = [], []
    for number, path in enumerate(paths, 1):
        file = container.resolve(spark, path.rstrip("/"))
        folder = file.rsplit("/", 1)[0] if file.endswith(f"/{container.FILE_NAME}") else file
        if file.endswith(".jkt"):
            tables, state = container.read_container(spark, [file], f"{staging}/{number}")
            cut.append(state.select(F.lit(number).cast("bigint").alias("run_id"), "incomplete"))
        else:
            tables = csv_run.read_csv_run(spark, file, number)
        runs.append((folder.rsplit("/", 1)[-1], tables))
    merged, labels = load_runs(runs)
    if not cut:
        return merged, labels.withColumn("incomplete", F.lit(False))
    tails = reduce(DataFrame.unionByName, cut)
    return merged, labels.join(tails, "run_id", "left").withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))
