"""Headline aggregates over public trades, and stage counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import not_rejected, public_only, public_trades

# Label of trades without a sector.
NO_SECTOR = "Unresolved / non-equity"


def _sums() -> list[Column]:
    return [
        F.coalesce(F.sum("amount_min"), F.lit(0).cast("bigint")).alias("sum_min"),
        F.coalesce(F.sum(F.coalesce("amount_max", "amount_min")), F.lit(0).cast("bigint")).alias("sum_max"),
    ]


def type_breakdown(trade, filing) -> DataFrame:
    return (
        public_trades(trade, filing)
        .groupBy("type")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "type")
    )


def _trades_and_pairs(trade, filing, corr, of_run: bool) -> DataFrame:
    """Per company: number of public trades, number of pairs and best signal. `of_run`: the pairs come
    straight from a run over these trades and name their company, so they are counted where they are."""
    if of_run:
        trades = public_trades(trade, filing).groupBy("company_id").agg(F.count(F.lit(1)).alias("trade_count"))
        counted = corr.groupBy("company_id").agg(F.count(F.lit(1)).alias("pairs"), F.max("signal").alias("best"))
        joined = trades.join(counted, "company_id", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("bigint")))
        return joined.select("company_id", "trade_count", F.col("pairs").alias("correlation_count"), F.col("best").alias("top_signal"))
    per_trade = corr.groupBy("trade_id").agg(F.count(F.lit(1)).alias("pairs"), F.max("signal").alias("best"))
    return (
        public_trades(trade, filing)
        .select(F.col("id").alias("trade_id"), "company_id")
        .join(per_trade, "trade_id", "left")
        .groupBy("company_id")
        .agg(
            F.count(F.lit(1)).alias("trade_count"),
            F.coalesce(F.sum("pairs"), F.lit(0).cast("bigint")).alias("correlation_count"),
            F.max("best").alias("top_signal"),
        )
    )


def list_companies(company, trade, filing, corr, *, of_run: bool = False) -> DataFrame:
    """Companies ranked by correlations, then trades. No distinct counts over a fan-out:
    pairs are counted per trade or company first, so each is one row in the join."""
    shown = corr.filter(not_rejected(F.col("verified")))
    counts = _trades_and_pairs(trade.filter(F.col("company_id").isNotNull()), filing, shown, of_run)
    firm = company.select(F.col("id"), "name", "ticker", "sector", "industry")
    return (
        firm.join(counts.withColumnRenamed("company_id", "id"), "id")
        .orderBy(F.desc("correlation_count"), F.desc("trade_count"), "id")
    )


def top_companies(listing: DataFrame, n: int = 5) -> DataFrame:
    order = [F.desc("correlation_count"), F.desc("trade_count"), F.asc("id")]
    return listing.filter(F.col("correlation_count") > 0).orderBy(*order).limit(n)


def site_stats(trade, filing) -> DataFrame:
    """Seven headline figures in one row."""
    header = public_only(filing).agg(
        F.count(F.lit(1)).alias("total_filings"), F.max("filing_date").alias("last_filing_date")
    )
    figures = public_trades(trade, filing).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.min("date").alias("earliest_date"),
        F.max("date").alias("latest_date"),
        *_sums(),
    )
    # both sides are single rows, so this pairs one row with one row
    return figures.join(header, F.lit(True))


def top_holdings(trade, filing, company, n: int = 5) -> DataFrame:
    per_company = (
        public_trades(trade.filter(F.col("company_id").isNotNull()), filing)
        .groupBy("company_id")
        .agg(F.count(F.lit(1)).alias("trade_count"), *_sums())
    )
    firm = company.select(F.col("id").alias("company_id"), "ticker", "name")
    return per_company.join(firm, "company_id").orderBy(F.desc("sum_max"), "company_id").limit(n)


def sector_breakdown(trade, filing, company) -> DataFrame:
    per_company = (
        public_trades(trade, filing)
        .groupBy("company_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("amount_min").alias("low"),
            F.sum(F.coalesce("amount_max", "amount_min")).alias("high"),
        )
    )
    firm = company.select(F.col("id").alias("company_id"), "sector")
    zero = F.lit(0).cast("bigint")
    return (
        per_company.join(firm, "company_id", "left")
        .groupBy(F.coalesce("sector", F.lit(NO_SECTOR)).alias("sector"))
        .agg(
            F.sum("n").alias("trade_count"),
            F.coalesce(F.sum("low"), zero).alias("sum_min"),
            F.coalesce(F.sum("high"), zero).alias("sum_max"),
        )
        .orderBy(F.desc("sum_max"), "sector")
    )


def sector_share(breakdown: DataFrame) -> DataFrame:
    """Each sector relative to the largest one; the input has one row per sector."""
    largest = F.max("sum_max").over(Window.partitionBy(F.lit(1)))
    return breakdown.withColumn("share", F.try_divide(F.col("sum_max").cast("double"), largest))


def gain_loss_leaders(stamped: DataFrame, per_side: int = 3) -> DataFrame:
    """The best gains above zero and the worst losses below zero."""
    best = stamped.filter(F.col("gain_loss_pct") > 0).orderBy(F.desc("gain_loss_pct"), "id").limit(per_side)
    worst = stamped.filter(F.col("gain_loss_pct") < 0).orderBy(F.asc("gain_loss_pct"), "id").limit(per_side)
    return best.withColumn("side", F.lit("gain")).unionByName(worst.withColumn("side", F.lit("loss")))


def ticker_priority(company, trade, filing, corr, *, of_run: bool = False) -> DataFrame:
    """Tickers of public trades, those with most correlations first."""
    per_company = _trades_and_pairs(trade, filing, corr, of_run).withColumnRenamed("correlation_count", "correlations")
    firm = company.filter(F.col("ticker").isNotNull()).select(F.col("id").alias("company_id"), "ticker")
    return (
        per_company.join(firm, "company_id")
        .groupBy("ticker")
        .agg(F.sum("correlations").alias("correlations"))
        .orderBy(F.desc("correlations"), "ticker")
    )


def ticker_budget(priority: DataFrame, cached: DataFrame, budget: int = 24) -> DataFrame:
    """The work list of one run: the first tickers without a stored series."""
    known = cached.select("ticker").distinct()
    return (
        priority.join(known, "ticker", "left_anti")
        .orderBy(F.desc("correlations"), "ticker")
        .limit(budget)
    )


def verdict_tally(corr: DataFrame) -> DataFrame:
    return corr.agg(
        F.count("verified").alias("verified"),
        F.count_if(F.col("verified")).alias("genuine"),
        F.count_if(~F.col("verified")).alias("false_matches"),
        F.count_if(F.col("verified").isNull()).alias("unverified"),
    )


def mention_counts(mention: DataFrame) -> DataFrame:
    return mention.groupBy("method", "company_id").agg(F.count(F.lit(1)).alias("n"))


def month_axis(days: DataFrame, day: str = "date", before: int = 60, after: int = 30) -> DataFrame:
    """Month starts inside the shown window and their position in percent of its width."""
    span = days.agg(
        F.date_sub(F.min(day), before).alias("low"), F.date_add(F.max(day), after).alias("high")
    )
    first = F.add_months(F.trunc("low", "month"), 1)
    months = F.when(first <= F.col("high"), F.sequence(first, F.col("high"), F.expr("interval 1 month")))
    return span.select("low", "high", F.explode(months).alias("month")).select(
        "month",
        F.date_format("month", "MMM yy").alias("label"),
        (F.datediff("month", "low") * 100.0 / F.datediff("high", "low")).alias("pct"),
    )


def usage_limits(requests: DataFrame, default_limit: int, keyed: DataFrame | None = None) -> DataFrame:
    """Requests used per subject and day against the subject's limit.

    Counters, not numbered requests: a subject with very many requests is pre-aggregated
    before the shuffle. `keyed` may carry own limits as (subject, daily_limit).
    """
    used = requests.groupBy("subject", "day").agg(F.count(F.lit(1)).alias("used"))
    if keyed is None:
        limited = used.withColumn("daily_limit", F.lit(default_limit).cast("bigint"))
    else:
        limited = used.join(keyed, "subject", "left").withColumn(
            "daily_limit", F.coalesce("daily_limit", F.lit(default_limit)).cast("bigint")
        )
    zero = F.lit(0).cast("bigint")
    return limited.withColumns(
        {
            "remaining": F.greatest(zero, F.col("daily_limit") - F.col("used")),
            "rejected": F.greatest(zero, F.col("used") - F.col("daily_limit")),
        }
    )
