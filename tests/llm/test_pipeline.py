"""The pipeline stage by stage on given rows."""

import os
import re

import pytest

import corpus_pipeline
from sightline.llm.common import written

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_stages(spark):
    docs = first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, FOLDER), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == first.columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    kept = {r.doc_id: r for r in seen["personal_data"].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    after_rules = {r.doc_id for r in seen["quality_rules"].collect()}
    assert not any(labels.get(i) == 0 for i in after_rules)
    texts = [r.text for r in seen["near_duplicates"].collect()]
    assert len(texts) == len(set(texts))
    for r in seen["repeated_passages"].collect():
        assert r.n_chars == len(r.text)
    for r in kept.values():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]+|AKIA[0-9A-Z]{16}", r.text)
    assert {r.doc_id for r in docs.collect()} == set(kept)
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, docs.drop("sequence_id", "offset").collect())
    )


def test_near_duplicates_keep_texts_that_share_an_id(spark):
    """Ids that restart: one text of a repeated id is a copy of a smaller id, others are unique."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(80))
    rows = [(1, "a"), (2, "b"), (2, "a"), (3, "c"), (3, "d"), (3, "e"), (4, "d"), (5, "a"), (3, "c"), (None, "a"), (None, "a")]
    docs = spark.createDataFrame([(i, text(name)) for i, name in rows], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    expected = [(1, "a"), (2, "b"), (3, "c"), (3, "d"), (3, "e"), (None, "a"), (None, "a")]
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), text(name)) for i, name in expected)
