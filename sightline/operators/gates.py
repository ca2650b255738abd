"""Row gates applied before anything is shown or correlated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that are released, trusted attribution methods, speaker confidence.
PUBLIC_STATUSES = ["parsed", "published"]
TRANSCRIPT, CAPTION = "official_transcript", "caption_derived"
SPEAKER_CONFIDENCE = 0.8


def public_only(filing: DataFrame) -> DataFrame:
    """Filings (or anything carrying their status) that are released."""
    return filing.filter(F.col("status").isin(PUBLIC_STATUSES))


def not_rejected(verdict: Column) -> Column:
    """True unless the verdict is an explicit false; unreviewed rows pass."""
    return ~verdict.eqNullSafe(F.lit(False))


def trusted_statement() -> Column:
    """Attribution is solved and no official text replaced the record."""
    captioned = (
        (F.col("method") == CAPTION)
        & (F.col("confidence") >= SPEAKER_CONFIDENCE)
        & ~F.col("needs_review").eqNullSafe(F.lit(True))
    )
    return F.col("superseded_by").isNull() & ((F.col("method") == TRANSCRIPT) | captioned)


def trusted_statements(statement: DataFrame) -> DataFrame:
    return statement.filter(trusted_statement())


def public_trades(trade: DataFrame, filing: DataFrame) -> DataFrame:
    """Trades of released filings, with the filer and filing facts the reads need.

    The only fact-to-fact join of the read side; the gate is applied before the join. A trade's
    own person, where it has one, comes before its filing's.
    """
    header = public_only(filing).select(
        F.col("id").alias("filing_id"),
        F.col("person_id").alias("_filer"),
        "filing_date",
        F.col("source_url").alias("filing_url"),
    )
    own = [F.col("person_id")] if "person_id" in trade.columns else []
    return trade.join(header, "filing_id").withColumn("person_id", F.coalesce(*own, "_filer")).drop("_filer")
