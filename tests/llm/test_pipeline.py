"""The pipeline's stages take effect and keep what they should."""

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns
    assert sum(i not in kept for i, t in labels.items() if t == 0) <= 0.02 * len(labels)
    once = corpus_pipeline.drop_near_duplicates(spark, clean, SF)
    texts = [r.text for r in once.collect()]
    assert once.columns == docs.columns and len(set(texts)) == len(texts) <= len(kept)
    cut = corpus_pipeline.cut_repeats(spark, once, SF)
    left = [r.text.encode() for r in cut.collect()]
    assert cut.columns == docs.columns and len(left) == len(texts) and sum(map(len, left)) <= sum(len(t.encode()) for t in texts)
    pieces = corpus_pipeline.pack_sequences(spark, cut, SF)
    assert pieces.filter("start = 0").count() == len(left)
    assert corpus_pipeline.run(spark, SF).filter("start = 0").count() == len(left)
