"""The training-data pipeline over `documents`: quality rules, near-duplicates, repeated passages,
personal data, packing. Each stage is written as Parquet and reread before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import packing, pii, quality, simhash, suffixes
from sightline.llm.common import unused, vocabulary, written


def _recounted(docs: DataFrame) -> DataFrame:
    """`n_chars` after the text has changed; the columns stay in place."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bounds of their language and source."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies the document with the least id, and of several texts with that id the
    one that names the group; rows without an id stay. Rows of one id are told apart by their texts:
    those with different texts are dropped or kept each by its own group, and of rows equal in
    id and text one is kept."""
    groups = simhash.similar_groups(docs)
    own = unused(docs.columns, "_digest")
    first = groups.where("doc_id = component_id AND digest = component_digest").select("doc_id", F.col("digest").alias(own)).distinct()
    by = ["doc_id", own]
    # the join has put the rows of an id and text together
    kept = docs.where("doc_id IS NOT NULL").withColumn(own, simhash.digest_of("text")).join(first, by, "left_semi").dropDuplicates(by)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur anywhere else too."""
    return _recounted(suffixes.remove(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    return _recounted(pii.redact(docs, pii.train(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Quantile sketches, fingerprints and a trained model have no SQL; a test goes stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
