"""As-of, latest and nearest prices.

Everything runs at day grain: trades are reduced to distinct (ticker, day) before the
windows, so a ticker holding a large part of all trades still gives a window partition no
longer than the number of calendar days; the trades join back on (ticker, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up


def _neighbours(trade: DataFrame, price: DataFrame) -> DataFrame:
    """Per (ticker, day) of a trade: last price on or before it, first one on or after it."""
    quote = F.struct(F.col("date").alias("on"), "close")
    quotes = price.select("ticker", "date", F.lit(1).alias("is_quote"), quote.alias("quote"))
    days = trade.select("ticker", "date").distinct().select(
        "ticker", "date", F.lit(0).alias("is_quote"), F.lit(None).cast(quotes.schema["quote"].dataType).alias("quote")
    )
    line = Window.partitionBy("ticker").orderBy("date", F.desc("is_quote"))
    back = Window.partitionBy("ticker").orderBy(F.desc("date"), F.desc("is_quote"))
    upto = (Window.unboundedPreceding, Window.currentRow)
    return (
        quotes.unionByName(days)
        .withColumn("before", F.last("quote", ignorenulls=True).over(line.rowsBetween(*upto)))
        .withColumn("after", F.last("quote", ignorenulls=True).over(back.rowsBetween(*upto)))
        .filter(F.col("is_quote") == 0)
        .select("ticker", "date", "before", "after")
    )


def asof_price(trade: DataFrame, price: DataFrame) -> DataFrame:
    """Trades with the last price on or before their day; NULL where there is none."""
    matched = _neighbours(trade, price).select(
        "ticker", "date", F.col("before.on").alias("price_date"), F.col("before.close").alias("price_at")
    )
    return trade.join(matched, ["ticker", "date"], "left")


def nearest_price(trade: DataFrame, price: DataFrame) -> DataFrame:
    """Trades snapped to the closest day of the series, the earlier one on a tie."""
    later = F.datediff("after.on", "date") < F.datediff("date", "before.on")
    pick = F.when(F.col("before").isNull() | later, F.coalesce("after", "before")).otherwise(F.col("before"))
    matched = _neighbours(trade, price).withColumn("pick", pick).select(
        "ticker", "date", F.col("pick.on").alias("snapped_date")
    )
    return trade.join(matched, ["ticker", "date"]).filter(F.col("snapped_date").isNotNull())


def latest_price(price: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """Newest stored price per ticker; a current quote, where there is one, wins."""
    newest = price.groupBy("ticker").agg(F.max_by("close", "date").alias("stored"))
    if quotes is None:
        return newest.select("ticker", F.col("stored").alias("price_now"))
    return newest.join(quotes.select("ticker", "quote"), "ticker", "left").select(
        "ticker", F.coalesce("quote", "stored").alias("price_now")
    )


def gain_loss_pct(price_at: Column, price_now: Column) -> Column:
    """Change in percent with one decimal; NULL when there is no positive start price."""
    return F.when(price_at > 0, half_up((price_now - price_at) / price_at * 1000) / 10)


def stamp_prices(trade: DataFrame, price: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """Trades that have a price at their day, with it, the current one and the change."""
    now = latest_price(price, quotes)
    return (
        asof_price(trade, price)
        .filter(F.col("price_at").isNotNull())
        .join(now, "ticker")
        .filter(F.coalesce(F.col("price_now"), F.lit(0.0)) != 0)
        .withColumn("gain_loss_pct", gain_loss_pct(F.col("price_at"), F.col("price_now")))
    )


def explode_price_series(payload: DataFrame, floor: str) -> DataFrame:
    """(ticker, json) rows of a date-keyed series to one row per valid price from `floor` on."""
    series = F.from_json("json", "map<string, struct<`4. close`: string>>")
    close = F.try_to_number(F.trim(F.col("entry.`4. close`")), F.lit("999999999999.9999999")).cast("double")
    return (
        payload.select("ticker", F.explode(series).alias("day", "entry"))
        .filter(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"))
        .select("ticker", F.try_to_date("day", "yyyy-MM-dd").alias("date"), close.alias("close"))
        .filter((F.col("close") > 0) & (F.col("date") >= F.lit(floor).cast("date")))
        .withColumn("close", half_up(F.col("close"), 2))
    )
