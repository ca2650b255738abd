"""The dashboard's figures as one long table, and row counters per stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A


def _long(df: DataFrame, prefix: str, name: str, value: str) -> DataFrame:
    return df.select(
        F.concat(F.lit(prefix), F.col(name)).alias("figure"), F.col(value).cast("double").alias("value")
    )


def dashboard(trade, filing, company, holdings: int = 5) -> DataFrame:
    """(figure, value): types, sectors, largest holdings and the headline figures."""
    stats = A.site_stats(trade, filing)
    figures = F.create_map(
        F.lit("transactions"), F.col("total_transactions").cast("double"),
        F.lit("filings"), F.col("total_filings").cast("double"),
        F.lit("value_min"), F.col("sum_min").cast("double"),
        F.lit("value_max"), F.col("sum_max").cast("double"),
    )
    parts = [
        _long(A.type_breakdown(trade, filing), "type:", "type", "n"),
        _long(A.sector_breakdown(trade, filing, company), "sector:", "sector", "sum_max"),
        _long(A.top_holdings(trade, filing, company, holdings), "holding:", "ticker", "sum_max"),
        stats.select(F.explode(figures).alias("figure", "value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def stage_counters(statement, mention, action, corr, price, filing) -> DataFrame:
    """(stage, part, n): what every stage has on record."""

    def counted(df: DataFrame, stage: str, part) -> DataFrame:
        return df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(stage).alias("stage"), "part", "n"
        )

    parts = [
        counted(statement, "statements", F.col("method")),
        counted(mention, "mentions", F.col("method")),
        counted(action, "actions", F.col("action_type")),
        counted(corr.filter(F.col("verified").isNull()), "unverified", F.lit("pairs")),
        counted(price, "prices", F.lit("points")),
        counted(filing.filter(F.col("status") != "superseded"), "filings", F.lit("active")),
    ]
    return reduce(DataFrame.unionByName, parts)
