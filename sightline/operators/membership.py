"""A filter of known keys that is asked before rows are shuffled.

The keys of one side are hashed into a blocked Bloom filter: an array of 64-bit words in which
each key sets BITS_SET bits of one word. The array has the same, given size whatever the keys are
(512 KB by default) and reaches the tasks as the value of a scalar subquery, so no job runs while a
plan is built. Rows whose key is not in it have no partner; those that pass are joined as usual,
so a crowded filter costs time but changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 65_536
BITS_SET = 2


def _word(key: Column, n_words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_words)).cast("int")


def _places(key: Column) -> list[Column]:
    """The bits of a key in its word, from the upper end of its hash."""
    return [F.shiftrightunsigned(F.xxhash64(key), 58 - 6 * n).bitwiseAND(F.lit(63)).cast("int") for n in range(BITS_SET)]


def _mask(key: Column) -> Column:
    one = F.lit(1).cast("bigint")
    first, *rest = [F.call_function("shiftleft", one, at) for at in _places(key)]
    for bit in rest:
        first = first.bitwiseOR(bit)
    return first


def key_filter(keys: DataFrame, column: str, n_words: int = WORDS) -> DataFrame:
    """One row with `words`, the filter of the values of a column; nulls are left out."""
    key = F.col(column)
    filled = keys.filter(key.isNotNull()).groupBy(_word(key, n_words).alias("at")).agg(F.bit_or(_mask(key)).alias("bits"))
    every = keys.sparkSession.range(n_words).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("bigint").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "bits")))
    return (
        filled.unionByName(every)
        .groupBy("at").agg(F.bit_or("bits").alias("bits"))
        .agg(F.transform(ordered, lambda w: w["bits"]).alias("words"))
    )


def may_hold(known: DataFrame, key: Column, n_words: int = WORDS) -> Column:
    """False only if the key is not in the filter `known`; null for a null key."""
    word = F.get(known.scalar(), _word(key, n_words))
    first, *rest = [F.call_function("shiftright", word, at) for at in _places(key)]
    for bit in rest:
        first = first.bitwiseAND(bit)
    return F.when(key.isNotNull(), first.bitwiseAND(F.lit(1)) == 1)
