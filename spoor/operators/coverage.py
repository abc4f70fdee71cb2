"""Execution counts, hot spots and comparison of runs of the same image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import text as X
from spoor.operators.history import newest

IDENTITY = ["machine", "pe_timestamp", "pe_checksum", "declared_image_size", "entry_point_rva"]


def execution_counts(evidence: DataFrame) -> DataFrame:
    return (evidence.filter(F.col("kind") == 4).groupBy("run_id", "iid", "tid")
            .agg(F.count(F.lit(1)).alias("executions")))


def coverage_totals(counts: DataFrame, instructions: DataFrame) -> DataFrame:
    """Executions per instruction definition; code revisions stay separate rows."""
    totals = counts.groupBy("run_id", "iid").agg(F.sum("executions").alias("executions"))
    return totals.join(instructions.select("run_id", "iid", "mid", "routine", "disassembly"), ["run_id", "iid"])


def hot_spots(counts: DataFrame, instructions: DataFrame, module: int | None = None,
              limit: int | None = None) -> DataFrame:
    """Instructions by executions, of one module or of every module, ties by instruction id; the first ``limit`` of each."""
    totals = coverage_totals(counts, instructions)
    if module is not None:
        totals = totals.filter(F.col("mid") == module)
    order = Window.partitionBy("run_id", "mid").orderBy(F.col("executions").desc(), "iid")
    ranked = totals.withColumn("position", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("position") <= limit)


def execution_count(counts: DataFrame, instructions: DataFrame, module: int, offset: int,
                    thread: int = -1) -> DataFrame:
    """One row per run: executions over every revision at an offset, 0 if none."""
    there = instructions.filter((F.col("mid") == module) & (F.col("off") == offset)).select("run_id", "iid")
    rows = counts if thread < 0 else counts.filter(F.col("tid") == thread)
    found = (rows.join(there, ["run_id", "iid"], "left_semi").groupBy("run_id")
             .agg(F.sum("executions").alias("_n")))
    return (counts.select("run_id").distinct().join(found, "run_id", "left")
            .select("run_id", F.coalesce("_n", F.lit(0)).alias("executions")))


def execution_count_by_offset(counts: DataFrame, instructions: DataFrame) -> DataFrame:
    """The same count for every known module offset at once."""
    totals = counts.groupBy("run_id", "iid").agg(F.sum("executions").alias("executions"))
    return (instructions.select("run_id", "iid", "mid", "off").join(totals, ["run_id", "iid"], "left")
            .groupBy("run_id", "mid", "off").agg(F.coalesce(F.sum("executions"), F.lit(0)).alias("executions")))


def image_key(modules: DataFrame) -> DataFrame:
    """Loaded modules with a valid PE identity and the name that identity is compared under."""
    return (modules.filter(F.col("loaded") & F.col("pe_identity_valid"))
            .withColumn("image_name", F.lower(X.basename("path"))))


def same_image(modules: DataFrame) -> DataFrame:
    """How many loaded modules of each run show each image identity."""
    key = ["image_name", *IDENTITY]
    return (image_key(modules).groupBy("run_id", *key)
            .agg(F.count(F.lit(1)).alias("copies"), F.min("module_id").alias("module_id")))


def compare_runs(evidence: DataFrame, instructions: DataFrame, modules: DataFrame, run: int, module: int,
                 offset: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Whole-run execution count, and the (newest) events, at an image offset in every run.

    A run takes part only if exactly one of its loaded modules is the same image.
    """
    key = ["image_name", *IDENTITY]
    keyed = image_key(modules)
    wanted = keyed.filter((F.col("run_id") == run) & (F.col("module_id") == module)).select(*key).distinct()
    matches = (keyed.join(wanted, key, "left_semi").groupBy("run_id")
               .agg(F.count(F.lit(1)).alias("copies"), F.min("module_id").alias("mid")))
    status = modules.select("run_id").distinct().join(matches, "run_id", "left")
    single = F.coalesce("copies", F.lit(0)) == 1
    there = (instructions.filter(F.col("off") == offset).select("run_id", "mid", "iid")
             .join(matches.filter("copies = 1"), ["run_id", "mid"], "left_semi").select("run_id", "iid"))
    hits = evidence.filter(F.col("seq") > 0).join(there, ["run_id", "iid"], "left_semi")
    executed = hits.filter(F.col("kind") == 4).groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = (status.join(executed, "run_id", "left")
              .select("run_id", F.when(single, "compared").otherwise("no single match").alias("status"),
                      F.when(single, F.coalesce("_n", F.lit(0))).alias("executions")))
    return counts, newest(hits, ["run_id"], limit)


def compare_offsets(counts: DataFrame, instructions: DataFrame, modules: DataFrame) -> DataFrame:
    """The comparison for every (image, offset) at once: executions per run of uniquely matched images."""
    key = ["image_name", *IDENTITY]
    unique = same_image(modules).filter("copies = 1").select("run_id", F.col("module_id").alias("mid"), *key)
    totals = counts.groupBy("run_id", "iid").agg(F.sum("executions").alias("executions"))
    return (instructions.select("run_id", "iid", "mid", "off").join(unique, ["run_id", "mid"])
            .join(totals, ["run_id", "iid"], "left")
            .groupBy(*key, "off", "run_id").agg(F.coalesce(F.sum("executions"), F.lit(0)).alias("executions")))


def code_bytes_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """Offsets of one image where two (image_name, off, encoding) code tables disagree."""
    a = left.select("image_name", "off", F.col("encoding").alias("left_code"))
    b = right.select("image_name", "off", F.col("encoding").alias("right_code"))
    return a.join(b, ["image_name", "off"]).filter(~F.col("left_code").eqNullSafe(F.col("right_code")))
