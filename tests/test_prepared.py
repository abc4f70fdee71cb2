"""Layout of prepared recordings."""

from pyspark.sql import functions as F

from spoor.plans import tables as t
from spoor.sources import prepared


def test_static_records_are_written_by_several_tasks(spark, tmp_path):
    """They all have sequence number 0, which one task would hold."""
    tables = t.all_tables(spark, "/root/testdata/sf0.001")
    definitions = spark.range(200_000).selectExpr(
        "1L AS run_id", "id + 1 AS instruction_id", "1L AS module_id", "CAST(id * 16 AS DECIMAL(20,0)) AS address",
        "CAST(id AS DECIMAL(20,0)) AS module_offset", "4L AS size", "sha2(CAST(id AS STRING), 256) AS routine",
        "sha2(CAST(-id AS STRING), 512) AS disassembly", "X'90' AS encoding_hex")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        prepared.prepare_run(spark, tables | {"instruction_definitions": definitions}, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    run = prepared.open_run(spark, str(tmp_path))
    rows = run["evidence"].filter("kind = 3").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in rows) == 200_000 and max(r["count"] for r in rows) < 100_000
    assert run["instructions"].count() == 200_000
    assert all(df.limit(1).count() == 1 for df in run.values())
