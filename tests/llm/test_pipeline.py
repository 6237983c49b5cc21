"""The pipeline's stages on a small corpus and on hard rows."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from ledgerloom.llm.common import stored  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids and len(now) > 0.7 * len(ids)
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "packing"]


def test_hard_rows(spark, hard_docs, no_docs, sf_dir):
    for docs in (hard_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
