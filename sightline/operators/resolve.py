"""Resolving security descriptions to companies, and awards to recipients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .membership import key_filter, may_hold

MIN_KEY, SPECIFIC_LENGTH = 3, 9
# Shares into which the awards of one recipient are dealt.
DEALS = 16


def name_map(titles: DataFrame) -> DataFrame:
    """(position, ticker, title) to one row per normalised name: the first title wins."""
    first = Window.partitionBy("name_key").orderBy("position")
    return (
        titles.withColumn("name_key", names.normalize_name(F.col("title")))
        .filter(F.col("name_key") != "")
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )


def description_keys(trade: DataFrame) -> DataFrame:
    """Distinct descriptions with their key; everything below runs on these, not on trades."""
    return trade.select("description").distinct().select(
        "description",
        names.is_non_equity(F.col("description")).alias("non_equity"),
        names.normalize_name(F.col("description")).alias("name_key"),
    )


def resolve_exact(keys: DataFrame, mapped: DataFrame) -> DataFrame:
    return keys.join(mapped, "name_key").withColumn("tier", F.lit("exact"))


def resolve_prefix(keys: DataFrame, mapped: DataFrame) -> DataFrame:
    """Keys that continue a specific enough mapped name after a blank; first in map order.

    Each key is expanded to its proper word prefixes, so the test is an equi-join and the
    map is never scanned per description.
    """
    words = F.split("name_key", " ")
    lengths = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1))
    prefixes = F.transform(lengths, lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    specific = mapped.filter(F.col("name_key").contains(" ") | (F.length("name_key") >= SPECIFIC_LENGTH))
    first = Window.partitionBy("description").orderBy("position")
    return (
        keys.withColumn("prefix", F.explode(prefixes))
        .join(specific.withColumnRenamed("name_key", "prefix"), "prefix")
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") == 1)
        .drop("_n", "prefix")
        .withColumn("tier", F.lit("prefix"))
    )


def resolve_descriptions(trade: DataFrame, titles: DataFrame) -> DataFrame:
    """Every distinct description with its outcome: bond, exact, prefix or unresolved."""
    mapped = name_map(titles)
    keys = description_keys(trade)
    usable = keys.filter(~F.col("non_equity") & (F.length("name_key") >= MIN_KEY))
    exact = resolve_exact(usable, mapped)
    rest = usable.join(mapped.select("name_key"), "name_key", "left_anti")
    hits = exact.unionByName(resolve_prefix(rest, mapped)).select("description", "ticker", "title", "tier")
    tier = F.when(F.col("non_equity"), "non_equity").otherwise(F.coalesce("tier", F.lit("unresolved")))
    return keys.join(hits, "description", "left").select("description", "ticker", "title", tier.alias("tier"))


def resolve_companies(trade: DataFrame, titles: DataFrame) -> DataFrame:
    """Trades with the ticker their description resolves to and how it was found."""
    return trade.join(resolve_descriptions(trade, titles), "description")


def new_companies(resolved: DataFrame, company: DataFrame) -> DataFrame:
    """Companies to create: resolved tickers that are not known yet, each once. Their id is the
    SHA-256 of the ticker, so two tickers never share one."""
    found = resolved.filter(F.col("ticker").isNotNull()).groupBy("ticker").agg(F.min("title").alias("name"))
    return found.join(company.select("ticker"), "ticker", "left_anti").select(
        F.sha2(F.encode("ticker", "UTF-8"), 256).alias("id"), "name", "ticker"
    )


def stamp_companies(resolved: DataFrame, company: DataFrame) -> DataFrame:
    """Resolved trades with a company id as text, existing or newly created."""
    known = company.select(F.col("id").cast("string").alias("id"), "ticker").unionByName(new_companies(resolved, company).select("id", "ticker"))
    found = resolved.filter(F.col("ticker").isNotNull()).join(known.withColumnRenamed("id", "new_company_id"), "ticker", "left")
    # unresolved trades would all share the key NULL; they go past the join
    rest = resolved.filter(F.col("ticker").isNull())
    return found.unionByName(rest.withColumn("new_company_id", F.lit(None).cast(found.schema["new_company_id"].dataType)))


def recipient_matches(company: DataFrame, award: DataFrame) -> DataFrame:
    """Awards whose recipient carries the first two distinctive words of a company, once for each such
    company.

    Words are compared once for each distinct word list and recipient (`_carried`); companies and awards
    meet on what was found. That may be many pairs of few recipients, so both are dealt over the
    configured number of tasks, which is not lowered, nor a side broadcast, for their small size.
    """
    own, carried = _carried(company, award)
    matched = own.join(carried, "tokens").select("company_id", "recipient", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("_deal"))
    tasks = int(award.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = award.withColumn("_deal", F.pmod(F.xxhash64(*award.columns), F.lit(DEALS)).cast("int"))
    return dealt.repartition(tasks, "recipient", "_deal").join(matched.hint("merge"), ["recipient", "_deal"]).drop("_deal")


def first_recipient_matches(company: DataFrame, award: DataFrame) -> DataFrame:
    """`recipient_matches` with the smallest company id of each award alone: no other pair is made."""
    own, carried = _carried(company, award)
    first = own.groupBy("tokens").agg(F.min("company_id").alias("company_id"))
    return award.join(carried.join(first, "tokens").groupBy("recipient").agg(F.min("company_id").alias("company_id")), "recipient")


def _carried(company: DataFrame, award: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(company_id, tokens) of the companies with a needed word, and (tokens, recipient): the word lists
    that a recipient carries.

    A needed word may be part of a longer word of the recipient. To stay an equi-join, each
    recipient is expanded to its substrings, of which only those that a filter of company words
    lets through leave the task; only the pairs found that way are checked in full.
    """
    # exploded, for a filter of the words would be moved below the reduction to distinct names
    words = F.explode(F.array(F.slice(names.distinctive_tokens(F.col("name")), 1, 2))).alias("tokens")
    named = company.select("name").distinct().select("name", words).filter(F.size("tokens") > 0)
    own = company.select(F.col("id").alias("company_id"), "name").join(named, "name").select("company_id", "tokens")
    needed = named.select("tokens").distinct().withColumn("token", F.get("tokens", F.lit(0)))
    recipients = award.select("recipient").distinct().withColumn("upper", F.upper("recipient"))
    pieces = recipients.select("recipient", F.explode(_pieces(F.col("upper"))).alias("token"))
    seen = pieces.filter(may_hold(key_filter(needed, "token"), F.col("token")))
    upper = F.upper("recipient")
    return own, needed.join(seen, "token").filter(F.forall("tokens", lambda t: F.contains(upper, t))).select("tokens", "recipient")


def _pieces(upper):
    """Distinct substrings of the letter-digit runs of a text. Company words are letters and
    digits, so one inside a recipient lies within one such run."""
    runs = F.regexp_extract_all(upper, F.lit("[A-Z0-9]+"), F.lit(0))

    def of_run(run):
        starts = F.sequence(F.lit(1), F.length(run))
        return F.flatten(F.transform(starts, lambda at: F.transform(
            F.sequence(F.lit(1), F.length(run) - at + 1), lambda n: F.substring(run, at, n)
        )))

    return F.array_distinct(F.flatten(F.transform(runs, of_run)))
