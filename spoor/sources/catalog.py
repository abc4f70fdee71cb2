"""Where recordings come from: source provenance and the catalog of capture sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = 8 * 1024 * 1024


def _hash_files(batches):
    import hashlib
    from urllib.parse import unquote

    import pandas as pd
    from pyarrow import fs
    for batch in batches:
        digests = []
        for path in batch["path"]:
            plain = unquote(path[5:]) if path.startswith("file:") else path
            system, inner = (fs.FileSystem.from_uri(path) if "://" in path and not path.startswith("file:")
                             else (fs.LocalFileSystem(), "/" + plain.lstrip("/")))
            digest = hashlib.sha256()
            with system.open_input_stream(inner) as stream:
                while data := stream.read(_CHUNK):
                    digest.update(data)
            digests.append(digest.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "sha256": digests})


def source_provenance(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Path, size, modification time and SHA-256 of every source file, hashed in chunks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    files = files.select("path", "length", "modificationTime")
    hashed = files.select("path").repartition("path").mapInPandas(_hash_files, "path string, sha256 string")
    return files.join(hashed, "path")


def _token() -> str:
    return r'("(?:[^"\\]|\\.)*"|\S+)'


def _unquote(text: Column) -> Column:
    inner = F.regexp_replace(F.substring(text, F.lit(2), F.length(text) - 2), r"\\(.)", "$1")
    return F.when(text.startswith('"'), inner).otherwise(text)


def session_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per session directory below ``root``, newest directory name first.

    A directory is a session if it holds session.info, trace.jkt or run.csv. Trace bytes are its own
    container plus those of its process-* children; without a container, the sum of its CSV files.
    """
    base = root.rstrip("/")
    relative = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    prefix = F.lit(base if "://" in base else "/" + base.lstrip("/"))
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
               .select(F.substring(relative, F.length(prefix) + 2, F.lit(1 << 20)).alias("rel"), "length"))
    parts = F.split("rel", "/")
    files = listing.select(parts[0].alias("session"), F.size(parts).alias("n"), "length",
                           F.element_at(parts, -1).alias("name"), F.try_element_at(parts, F.lit(2)).alias("second"))
    direct = F.col("n") == 2
    child = (F.col("n") == 3) & F.col("second").startswith("process-") & (F.col("name") == "trace.jkt")
    own = direct & (F.col("name") == "trace.jkt")
    rows = files.filter(F.col("n") >= 2).groupBy("session").agg(
        F.max(own).alias("has_trace"),
        F.max(direct & F.col("name").isin("session.info", "trace.jkt", "run.csv")).alias("_is"),
        F.max(direct & (F.col("name") == "run.csv")).alias("_csv_run"),
        F.sum(F.when(own | child, F.col("length")).otherwise(0)).alias("_traces"),
        F.sum(F.when(direct & F.col("name").endswith(".csv"), F.col("length")).otherwise(0)).alias("_csv"))
    rows = rows.filter("_is").withColumn(
        "trace_bytes", F.col("_traces") + F.when(~F.col("has_trace") & F.col("_csv_run"), F.col("_csv")).otherwise(0))
    # Only the four small text files are read.
    notes = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "{session.info,session.done,writer-performance.json,instrumentation-performance.json}")
             .load(base).select(F.substring(relative, F.length(prefix) + 2, F.lit(1 << 20)).alias("rel"),
                                F.col("content").cast("string").alias("text")))
    notes = notes.select(F.split("rel", "/").alias("p"), "text").filter(F.size("p") == 2).groupBy(
        F.col("p")[0].alias("session")).agg(F.map_from_entries(F.collect_list(
            F.struct(F.col("p")[1], F.col("text")))).alias("notes"))   # at most four per session
    joined = rows.join(notes, "session", "left")

    def note(name):
        return F.try_element_at("notes", F.lit(name))

    info = r"^\s*" + r"\s+".join([_token()] * 3) + r"\s+(-?\d+)"

    def info_field(i):
        return F.regexp_extract(F.coalesce(note("session.info"), F.lit("")), info, i)

    def number(name, key):
        value = F.regexp_extract(F.coalesce(note(name), F.lit("")), f'"{key}"[^:]*:\\s*([-+0-9.eE]+)', 1)
        return F.coalesce(value.try_cast("double"), F.lit(0.0))

    done = r"^\s*(-?\d+)\s+(-?\d+)"
    finished = F.coalesce(note("session.done"), F.lit(""))
    failed = F.coalesce(note("writer-performance.json"), F.lit("")).rlike(r'"storage_failed"[^:]*:\s*true')
    return joined.select(
        "session", _unquote(info_field(1)).alias("target"), _unquote(info_field(2)).alias("arguments"),
        _unquote(info_field(3)).alias("scope"), info_field(4).try_cast("bigint").alias("started_at"),
        F.regexp_extract(finished, done, 1).try_cast("bigint").alias("finished_at"),
        F.regexp_extract(finished, done, 2).try_cast("bigint").alias("exit_code"), "has_trace", "trace_bytes",
        number("writer-performance.json", "completed_blocks").cast("bigint").alias("completed_blocks"),
        failed.alias("storage_failed"),
        number("instrumentation-performance.json", "translation_callback_seconds").alias("translation_seconds"),
    ).orderBy(F.col("session").desc())
