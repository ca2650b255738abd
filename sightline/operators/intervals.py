"""Equi-key plus date-window join on day-grain keys.

Both sides carry a coarse date bucket as wide as the window, so a key that holds a large
part of the data is spread over many (key, bucket) groups. Callers pass the left side at
day grain (one row per key and day), so a row of the right side meets at most
``before + after + 1`` left rows, however hot its key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_bucket(day: Column, width: int) -> Column:
    return F.floor(F.unix_date(day) / F.lit(width)).cast("int")


def window_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_day: str,
    right_day: str,
    before: int,
    after: int,
) -> DataFrame:
    """Pairs with equal keys and right_day within [left_day - before, left_day + after].

    The left side is small and multiplies in the join, so it is spread over the configured
    number of partitions by (keys, day); a fixed number keeps them from being merged for
    their small size. Where the right side is broadcast, later windows over (keys, day) find
    their rows already together.
    """
    width = before + after + 1
    spread_over = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = date_bucket(F.date_sub(F.col(left_day), before), width)
    last = date_bucket(F.date_add(F.col(left_day), after), width)
    spread = left.repartition(spread_over, *keys, left_day).withColumn("_bucket", F.explode(F.sequence(first, last)))
    tagged = right.withColumn("_bucket", date_bucket(F.col(right_day), width))
    gap = F.datediff(F.col(right_day), F.col(left_day))
    return (
        spread.join(tagged, [*keys, "_bucket"])
        .filter(gap.between(-before, after))
        .withColumn("days_gap", gap)
        .drop("_bucket")
    )
