"""Extra columns whose names clash with working names, or need quoting, come through every stage."""

import corpus_pipeline
from sightline.llm import pii, quality, simhash, suffixes

CLASHING = ["kept", "_id", "_marks", "_digest", "_m", "_o", "odd name", "Size", "node", "copy"]


def clashing(spark):
    body = " ".join(f"word{i}" for i in range(120))
    rows = [(1, body), (1, body), (2, body + " mail me at ann@example.org"), (None, "x" * 1_000_000), (3, ""), (4, None), (5, "lone words here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) + tuple(range(len(CLASHING))) for i, t in rows], ", ".join(
        ["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{c}` int" for c in CLASHING)]
    ))
    return docs


def test_operators_keep_clashing_columns(spark):
    docs = clashing(spark)
    for out in (pii.redact(docs, pii.train(docs)), suffixes.remove(docs), quality.keep_good(docs)):
        assert out.columns == docs.columns
        assert all(tuple(r)[5:] == tuple(range(len(CLASHING))) for r in out.collect())
    judged = quality.judge(docs)
    assert judged.columns.count("kept") == 1 and judged.where("NOT kept").count() > 0
    assert simhash.similar_groups(docs).count() == 6


def test_pipeline_stages_keep_clashing_columns(spark):
    docs = clashing(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert all(tuple(r)[5:] == tuple(range(len(CLASHING))) for r in out.collect()), name
