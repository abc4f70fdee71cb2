"""Written intermediate tables in the shared folder, and joins by id whose broadcast side is checked first."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.session import scratch_path

#: Rows of 64-bit ids that may be broadcast (a few dozen MB in an executor); beyond it the join shuffles.
BROADCAST_IDS = 400_000


_own = threading.local()     # for each thread, the tables written for results that are not settled yet


def _scopes() -> list[list[str]]:
    return _own.__dict__.setdefault("scopes", [])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: lineage ends here, nothing runs twice."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if _scopes():
        _scopes()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows that `make` returns, written; the tables it wrote on its way are deleted, for nothing needs them now."""
    _scopes().append([])
    try:
        df = make()
        path = scratch_path(spark, name)
        df.write.parquet(path)
    finally:
        for old in _scopes().pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in the (distinct) ids. Few ids go to every task, so a large df is not shuffled."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a written table that is needed no more."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def retexted(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """docs with the texts of `changed` (__id, __kept; few documents) in place of their own; where `changed` has __sha, in
    place of the text of that SHA-256 only. Unchanged documents are passed on where they lie when the changed ids are few
    enough to send to every task."""
    ids = changed.select("__id").distinct()
    text = {"text": F.col("__kept")}
    if "n_chars" in docs.columns:
        text["n_chars"] = F.length("__kept").cast(docs.schema["n_chars"].dataType)
    kept = {c: F.when(F.col("__id").isNull(), F.col(c)).otherwise(v).alias(c) for c, v in text.items()}
    by = F.col("doc_id") == F.col("__id")
    if "__sha" in changed.columns:
        by = by & (F.sha2(F.col("text").cast("string"), 256) == F.col("__sha"))
    changed = changed.dropDuplicates([c for c in changed.columns if c != "__kept"])
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        near = F.broadcast(ids)
        few = docs.join(near, F.col("doc_id") == F.col("__id"), "left_semi").join(changed, by, "left")
        rest = docs.join(near, F.col("doc_id") == F.col("__id"), "left_anti")
        return rest.unionByName(few.select(*[kept.get(c, F.col(c)) for c in docs.columns]))
    return docs.join(changed, by, "left").select(*[kept.get(c, F.col(c)) for c in docs.columns])
