"""Extraction quality, publication state and duplicate handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import BAND_COUNT
from ..functions.numeric import half_up

# Known transaction types and the weights of the filing confidence.
KNOWN_TYPES = ["Purchase", "Sale", "Sale (Partial)", "Exchange"]
PARSE_THRESHOLD, TRUNCATION_SHARE, ALTERNATIVE_CONFIDENCE = 0.7, 0.85, 0.92
PERIODIC_FORM = "278-T"


def row_issues(date: Column, band: Column, description: Column) -> Column:
    """Names of the fields that keep a row from being publishable; the type is not one."""
    day = F.try_to_date(date.cast("string"), "yyyy-MM-dd")
    return F.array_compact(
        F.array(
            F.when(day.isNull(), "date"),
            F.when(~F.coalesce(band.between(1, BAND_COUNT), F.lit(False)), "band"),
            F.when(F.coalesce(F.length(description), F.lit(0)) < 3, "description"),
        )
    )


def with_row_quality(rows: DataFrame) -> DataFrame:
    """Adds `issues` and `row_confidence`: 0.3 invalid, 1 with a known type, else 0.7."""
    issues = row_issues(F.col("date"), F.col("band"), F.col("description"))
    return rows.withColumn("issues", issues).withColumn(
        "row_confidence",
        F.when(F.size("issues") > 0, 0.3).when(F.col("type").isin(KNOWN_TYPES), 1.0).otherwise(0.7),
    )


def filing_confidence(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Confidence per filing from its rows (filing_id, date, band, description, type) and
    pages (filing_id, page, text_source, rows_found, declared_total)."""
    valid = F.size("issues") == 0
    per_row = with_row_quality(rows).groupBy("filing_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(valid.cast("double")).alias("valid_share"),
        F.avg(F.col("type").isin(KNOWN_TYPES).cast("double")).alias("type_share"),
        F.min(F.when(valid, F.col("date"))).alias("period_start"),
        F.max(F.when(valid, F.col("date"))).alias("period_end"),
    )
    data_page = F.col("rows_found") > 0
    per_page = pages.groupBy("filing_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(data_page).alias("data_pages"),
        F.count_if(data_page & (F.col("text_source") == "ocr")).alias("ocr_pages"),
        F.min_by("declared_total", F.when(F.col("declared_total").isNotNull(), F.col("page"))).alias("declared"),
    )
    ocr_share = F.col("ocr_pages") / F.greatest(F.col("data_pages"), F.lit(1))
    reconciled = F.col("declared").isNull() | (F.col("declared") == F.col("page_count"))
    base = F.col("valid_share") * (0.75 + 0.25 * F.col("type_share")) * (1 - 0.1 * F.col("ocr_share"))
    discounted = F.when(F.col("page_reconciled"), base).otherwise(base * 0.85)
    return (
        per_page.join(per_row, "filing_id", "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
        .withColumn("ocr_share", F.when(F.col("rows") == 0, 1.0).otherwise(ocr_share))
        .withColumn("page_reconciled", (F.col("rows") > 0) & reconciled)
        .withColumn("confidence", F.when(F.col("rows") == 0, 0.0).otherwise(half_up(discounted, 3)))
        .select(
            "filing_id", "rows", "page_count", "ocr_share", "page_reconciled", "confidence",
            "period_start", "period_end",
        )
    )


def parse_gate(filing, rows, pages, threshold: float = PARSE_THRESHOLD, form: str = PERIODIC_FORM) -> DataFrame:
    """Pending filings with the state that their extraction earns. Other forms are skipped
    as parsed and empty; the rest is parsed at or above the threshold, else in review."""
    pending = filing.filter(F.col("status") == "pending").select(
        F.col("id").alias("filing_id"), "form_type"
    )
    scored = filing_confidence(rows, pages)
    periodic = F.col("form_type") == form
    confidence = F.coalesce("confidence", F.lit(0.0))
    return pending.join(scored, "filing_id", "left").select(
        "filing_id",
        F.when(~periodic | (confidence >= threshold), "parsed").otherwise("review").alias("status"),
        F.when(periodic, F.coalesce("rows", F.lit(0))).otherwise(0).cast("bigint").alias("transaction_count"),
        F.when(periodic, confidence).alias("confidence"),
        F.when(~periodic, "skipped")
        .when(F.coalesce("ocr_share", F.lit(1.0)) > 0, "heuristic-ocr")
        .otherwise("heuristic-embedded").alias("method"),
        F.when(periodic, F.col("period_start")).alias("period_start"),
        F.when(periodic, F.col("period_end")).alias("period_end"),
    )


def choose_extraction(first: DataFrame, alternative: DataFrame) -> DataFrame:
    """Per filing, which extraction to keep: (filing_id, rows, confidence) against
    (filing_id, rows, truncated). The alternative must be whole and improve confidence."""
    other = alternative.select("filing_id", F.col("rows").alias("other_rows"), "truncated")
    better = (
        F.col("other_rows").isNotNull()
        & ~F.coalesce("truncated", F.lit(False))
        & (F.col("other_rows") >= F.col("rows") * TRUNCATION_SHARE)
        & (F.col("confidence") < ALTERNATIVE_CONFIDENCE)
    )
    keep = F.coalesce(better, F.lit(False))
    return first.join(other, "filing_id", "left").select(
        "filing_id",
        F.when(keep, "alternative").otherwise("heuristic").alias("chosen"),
        F.when(keep, F.col("other_rows")).otherwise(F.col("rows")).alias("rows"),
        F.when(keep, ALTERNATIVE_CONFIDENCE).otherwise(F.col("confidence")).alias("confidence"),
    )


def dedupe_filings(filing: DataFrame, preferred_domain: str) -> DataFrame:
    """Copies of a filing on other sites are superseded by the preferred site's copy.

    A group is (filer, filing date, form), where missing values are equal. Groups are aggregated first and joined back, so
    a very large group is never one window partition.
    """
    key = ["person_id", "filing_date", "form_type"]
    preferred = F.col("source_domain") == preferred_domain
    canonical = filing.filter(preferred).groupBy(*key).agg(F.min("id").alias("canonical"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    marked = filing.join(canonical.withColumnsRenamed({k: f"_{k}" for k in key}), same, "left")
    replaced = F.col("canonical").isNotNull() & ~preferred & (F.col("status") != "superseded")
    return marked.select(
        "id", *key, "source_domain",
        F.when(replaced, "superseded").otherwise(F.col("status")).alias("status"),
        F.when(replaced, F.col("canonical")).alias("supersedes_id"),
    )


def dedupe_pairs(corr: DataFrame) -> DataFrame:
    """One row per (trade, kind, event): a reviewed one first, then the newest."""
    order = Window.partitionBy("trade_id", "kind", "event_id").orderBy(
        F.col("verified").isNotNull().desc(), F.desc("created_at"), F.desc("id")
    )
    return corr.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).drop("_n")


def apply_decisions(filing: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviewers' decisions (filing_id, decision, decided_at): the last one sets the status."""
    last = decisions.groupBy(F.col("filing_id").alias("id")).agg(
        F.max_by("decision", "decided_at").alias("decision")
    )
    # Decision to status.
    status = F.when(F.col("decision") == "publish", "published").when(F.col("decision") == "withhold", "review")
    return filing.join(last, "id", "left").withColumn("status", F.coalesce(status, "status")).drop("decision")
