"""The corpus pipeline, stage by stage, against brute force over what the stage before it kept."""

import corpus_pipeline
from spoor.llm import quality
from spoor.llm.shared import written
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        result = written(stage(spark, docs, SF), f"test-{name}")
        if name == "best_fit_packing":
            assert {r.doc_id for r in result.collect()} == set(before)
            break
        assert result.columns == columns
        after = {r.doc_id: r.text for r in result.collect()}
        if name == "quality_classifier":
            bad = {r.doc_id for r in quality.predictions(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if not r.predicted}
            assert bad and after == {i: t for i, t in before.items() if i not in bad}
        elif name == "line_dedup":
            assert after == {i: kept for i, (_, _, kept) in brute.dropped_lines(list(before.items())).items()}
        elif name == "near_dedup":
            assert after == {i: before[i] for i, (_, c) in brute.near_duplicates(list(before.items())).items() if i == c}
        elif name == "substring_dedup":
            assert after == {i: " ".join(kept) if len(kept) < n else before[i] for i, (n, kept) in brute.repeated_words(list(before.items())).items()}
        docs = result
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
