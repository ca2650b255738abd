"""Corroboration of disclosed trades by records of independent sources.

A record corroborates a trade of the same day when the tickers are equal, or one
normalised description starts with the other, and the amount ranges overlap. Both sides
are first reduced to distinct keys, so equal rows never meet each other pairwise; only the
smallest trade id of a key matters because the first matching trade wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .membership import key_filter, may_hold

MIN_DESCRIPTION = 4
UNBOUNDED = 2**62
RANGE = ["amount_min", "amount_max"]


def _overlaps() -> Column:
    """Ranges overlap, or the record reports none; an open end has no upper bound."""
    our_max = F.coalesce("our_max", F.lit(UNBOUNDED))
    rec_max = F.coalesce("rec_max", F.lit(UNBOUNDED))
    return F.col("rec_min").isNull() | ((F.col("rec_min") <= our_max) & (F.col("our_min") <= rec_max))


def _with_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a day and a key. Tickers are dealt by both: a day has few rows of one ticker, so reducing
    them first would shuffle nearly all of them once more for the join."""
    known = rows.filter(F.col("date").isNotNull() & F.col(key).isNotNull())
    return known.repartition("date", key) if key == "ticker" else known


def _first_trade(trade: DataFrame, key: str) -> DataFrame:
    """Smallest trade id per (day, key, range)."""
    return (
        _with_key(trade, key)
        .groupBy("date", key, F.col("amount_min").alias("our_min"), F.col("amount_max").alias("our_max"))
        .agg(F.min("id").alias("trade_id"))
    )


def _record_keys(record: DataFrame, key: str) -> DataFrame:
    return (
        _with_key(record, key)
        .select("date", key, F.col("amount_min").alias("rec_min"), F.col("amount_max").alias("rec_max"))
        .distinct()
    )


def _beginnings(keys: DataFrame, others: DataFrame) -> DataFrame:
    """`keys` once for each beginning (`part`) of their text that may be a text of the same day in
    `others`. Beginnings are tested where they are made, so only likely partners are shuffled."""

    def of_day(text: str) -> Column:
        return F.struct("date", F.col(text).alias("text"))

    known = key_filter(others.filter("text IS NOT NULL").select(of_day("text").alias("key")), "key")
    lengths = F.sequence(F.lit(MIN_DESCRIPTION), F.length("text"))
    parts = F.transform(lengths, lambda n: F.substring(F.col("text"), F.lit(1), n))
    return keys.withColumn("part", F.explode(parts)).filter(may_hold(known, of_day("part")))


REC = ["date", "rec_min", "rec_max"]


def match_records(trade: DataFrame, company: DataFrame, record: DataFrame) -> DataFrame:
    """Records with the id of the trade they corroborate, NULL when there is none.

    trade: id, company_id, description, date, amount_min, amount_max
    record: record_id, source, date, ticker, description, amount_min, amount_max
    """
    firm = company.select(F.col("id").alias("company_id"), F.upper("ticker").alias("ticker"))
    ours = trade.join(firm, "company_id", "left").select(
        "id", "date", "ticker", names.normalize_description(F.col("description")).alias("text"), *RANGE
    ).withColumn("text", F.when(F.length("text") >= MIN_DESCRIPTION, F.col("text")))
    theirs = record.select(
        "record_id", "source", "date", F.upper("ticker").alias("ticker"),
        names.normalize_description(F.col("description")).alias("text"), *RANGE,
    ).withColumn("text", F.when(F.length("text") >= MIN_DESCRIPTION, F.col("text")))

    by_ticker = (
        _record_keys(theirs, "ticker")
        .join(_first_trade(ours, "ticker"), ["date", "ticker"])
        .filter(_overlaps())
        .groupBy(*REC, "ticker")
        .agg(F.min("trade_id").alias("by_ticker"))
    )
    our_texts = _first_trade(ours, "text")
    rec_texts = _record_keys(theirs, "text")
    # the record's text begins with ours, or ours begins with the record's: two equi-joins
    ours_shorter = _beginnings(rec_texts, ours).join(
        our_texts.withColumnRenamed("text", "part"), ["date", "part"]
    )
    ours_longer = rec_texts.withColumn("part", F.col("text")).join(
        _beginnings(our_texts, theirs).drop("text"), ["date", "part"]
    )
    by_text = (
        ours_shorter.select(*REC, "text", "our_min", "our_max", "trade_id")
        .unionByName(ours_longer.select(*REC, "text", "our_min", "our_max", "trade_id"))
        .filter(_overlaps())
        .groupBy(*REC, "text")
        .agg(F.min("trade_id").alias("by_text"))
    )
    keyed = theirs.withColumnsRenamed({"amount_min": "rec_min", "amount_max": "rec_max"})

    def attach(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        same = [left[c].eqNullSafe(right[c]) for c in ("rec_min", "rec_max")]
        cond = (left["date"] == right["date"]) & (left[key] == right[key]) & same[0] & same[1]
        return left.join(right, cond, "left").select(left["*"], right[f"by_{key}"])

    matched = attach(attach(keyed, by_ticker, "ticker"), by_text, "text")
    return matched.select(
        "record_id", "source", "date", "rec_min", "rec_max",
        F.least("by_ticker", "by_text").alias("trade_id"),
    )


def reconciled_sources(matches: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Sorted union of corroborating sources per trade, with whether it is news."""
    found = (
        matches.filter(F.col("trade_id").isNotNull())
        .groupBy("trade_id")
        .agg(F.array_sort(F.collect_set("source")).alias("found"))
    )
    empty = F.array().cast("array<string>")
    if prior is None:
        before = found.withColumn("prior", empty)
    else:
        before = found.join(prior.select("trade_id", "prior"), "trade_id", "left").withColumn(
            "prior", F.coalesce("prior", empty)
        )
    sources = F.array_sort(F.array_union("prior", "found"))
    return before.select("trade_id", sources.alias("sources"), "prior").withColumn(
        "already_reconciled", F.size("sources") == F.size("prior")
    )


def reconcile_summary(matches: DataFrame, sources: DataFrame) -> DataFrame:
    records = matches.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("trade_id").isNull()).alias("unmatched_records")
    )
    trades = sources.agg(
        F.count(F.lit(1)).alias("matched"), F.count_if("already_reconciled").alias("already_reconciled")
    )
    return records.join(trades, F.lit(True))  # one row with one row


def band_conflicts(trade: DataFrame, company: DataFrame, record: DataFrame) -> DataFrame:
    """Records that name a traded ticker and day, but whose range meets none of its trades."""
    firm = company.select(F.col("id").alias("company_id"), F.upper("ticker").alias("ticker"))
    ranges = (
        trade.join(firm, "company_id")
        .groupBy("date", "ticker", F.col("amount_min").alias("our_min"), F.col("amount_max").alias("our_max"))
        .agg(F.min("id").alias("trade_id"))
    )
    keys = _record_keys(record.withColumn("ticker", F.upper("ticker")), "ticker")
    judged = (
        keys.filter(F.col("rec_min").isNotNull())
        .join(ranges, ["date", "ticker"])
        .groupBy("date", "ticker", "rec_min", "rec_max")
        .agg(F.min("trade_id").alias("trade_id"), F.max(_overlaps()).alias("fits"))
        .filter(~F.col("fits"))
        .drop("fits")
    )
    rec = record.select("record_id", "source", "date", F.upper("ticker").alias("ticker"), *RANGE)
    cond = (
        (rec["date"] == judged["date"])
        & (rec["ticker"] == judged["ticker"])
        & rec["amount_min"].eqNullSafe(judged["rec_min"])
        & rec["amount_max"].eqNullSafe(judged["rec_max"])
    )
    return rec.join(judged, cond).select(
        "record_id", "source", rec["date"], rec["ticker"], "rec_min", "rec_max", "trade_id"
    )
