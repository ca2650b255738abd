"""The operators applied to the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, minhash, overlap, packing, pieces, pii, quality, simhash, suffixes, token_counts, urls, warc
from .common import fresh_folder, table, vocabulary, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op9_quality": quality.ORACLE,
    "op13_filter_audit": audit.ORACLE,
}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and digest of a revisit are those of the response that it refers to."""
    archives = fresh_folder(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), archives)
    captures = written(warc.assemble(warc.read_archives(spark, archives, with_block=False)), "captures")
    resolved = warc.resolve(captures)
    return resolved.select(
        F.expr("try_cast(metadata.fields['page-id'] AS bigint)").alias("page_id"),
        F.coalesce("origin.payload_bytes", "response.payload_bytes").alias("payload_bytes"),
        F.coalesce("origin.payload_digest", "response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("origin.page_id").alias("refers_to"),
    )


@query
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    edited = minhash.with_edit(table(spark, folder, "documents"))
    edited = minhash.with_fingerprint(edited, "edited", "edited_fingerprint")
    return edited.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        minhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        minhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


@query
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.measure(table(spark, folder, "documents"))


@query
def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), keep_ids=False)


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select("doc_id", *quality.BASE, "base_failed", "kept")


@query
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    order = {k: i for i, k in enumerate(pii.KINDS)}
    rank = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])

    def joined(spans: Column) -> Column:
        placed = F.sort_array(F.transform(spans, lambda s: F.struct(s.start.alias("start"), rank[s.kind].alias("rank"), s.end.alias("end"), s.kind.alias("kind"))))
        return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    kinds = F.transform("base", lambda s: s.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans")
    )


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Null, empty and unfaithfully encoded texts are as in `alignment.align`."""
    return alignment.align(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without words or with a null key are as in `overlap.near_duplicates`."""
    return overlap.near_duplicates(table(spark, folder, "documents"))


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a null doc_id never repeat another; null texts and sources are empty strings."""
    return audit.interactions(audit.flag_counts(table(spark, folder, "documents"), table(spark, folder, "labels")))
