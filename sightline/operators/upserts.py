"""Idempotent writes as joins: the result is the new table content or the rows to append."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["trade_id", "kind", "event_id"]


def insert_if_new(target: DataFrame, batch: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    """Rows of the batch whose key is not in the target, each key once (first by `order`)."""
    if order:
        first = Window.partitionBy(*key).orderBy(*order)
        once = batch.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")
    else:
        once = batch.dropDuplicates(key)
    return once.join(target.select(*key), key, "left_anti")


def insert_counts(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """How many rows of a batch are inserted and how many are skipped."""
    added = insert_if_new(target, batch.select(*key), key).agg(F.count(F.lit(1)).alias("inserted"))
    seen = batch.agg(F.count(F.lit(1)).alias("rows"))
    return seen.join(added, F.lit(True)).select(  # one row with one row
        "inserted", (F.col("rows") - F.col("inserted")).alias("skipped")
    )


def get_or_create(dimension: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The dimension's keys with ids as text, extended by a stable id for every unknown key: the
    SHA-256 of the key, so that two keys never share one."""
    new = names.select(key).filter(F.col(key).isNotNull()).distinct().join(
        dimension.select(key), key, "left_anti"
    )
    return dimension.select(F.col("id").cast("string").alias("id"), key, F.lit(False).alias("created")).unionByName(
        new.select(F.sha2(F.encode(key, "UTF-8"), 256).alias("id"), key, F.lit(True).alias("created"))
    )


def upsert_correlations(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Fresh scores with the verdicts of the old rows; pairs no longer produced are gone.

    `by`, here and below: columns that are the same for a pair on both sides, such as the company. Where
    both lie together by them, as pairs of a run do, no pair is shuffled.
    """
    # an old row with neither changes nothing
    said = F.col("verified").isNotNull() | F.col("reason").isNotNull()
    verdicts = old.filter(said).select(*by, *PAIR, "verified", "reason")
    keep = [c for c in new.columns if c not in ("verified", "reason")]
    return new.select(*keep).join(verdicts, [*by, *PAIR], "left")


def prune_stale(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Old pairs that the new run no longer produces."""
    return old.join(new.select(*by, *PAIR), [*by, *PAIR], "left_anti")


def apply_verdicts(corr: DataFrame, verdicts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Overlay reviewed pairs (id, genuine, reason) on correlations; all others keep what they have."""
    given = verdicts.select(*by, "id", F.col("genuine").alias("_genuine"), F.col("reason").alias("_reason"), F.lit(True).alias("_given"))
    joined = corr.join(given, [*by, "id"], "left")
    stored = F.col("reason") if "reason" in corr.columns else F.lit(None).cast("string")
    return joined.withColumns({
        "verified": F.when(F.col("_given"), F.col("_genuine")).otherwise(F.col("verified")),
        "reason": F.when(F.col("_given"), F.col("_reason")).otherwise(stored),
    }).drop("_genuine", "_reason", "_given")


def verdict_candidates(corr, trade, company, statement, action, cut: int = 600) -> DataFrame:
    """Unreviewed pairs with the company and the beginning of the event's text."""
    firm = trade.select(F.col("id").alias("trade_id"), "company_id").join(
        company.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "ticker"), "company_id"
    )
    texts = event_texts(statement, action, cut).withColumnRenamed("text", "event_text")
    return (
        corr.filter(F.col("verified").isNull())
        .select("id", *PAIR)
        .join(firm, "trade_id")
        .join(texts, ["kind", "event_id"], "left")
        .select("id", "company", "ticker", "kind", F.coalesce("event_text", F.lit("")).alias("event_text"))
    )


def event_texts(statement, action, cut: int = 600) -> DataFrame:
    """(kind, event_id, text): the beginning of every event's text."""
    rows = [
        df.select(F.lit(kind).alias("kind"), F.col("id").alias("event_id"), F.substring(text, 1, cut).alias("text"))
        for df, kind, text in ((statement, "statement", "full_text"), (action, "action", "title"))
    ]
    return rows[0].unionByName(rows[1])


def verdict_candidates_of_run(pairs) -> DataFrame:
    """`verdict_candidates` of pairs as `correlate` gives them with the facts `event_texts` and the name and
    ticker of their company: nothing is joined with them, so they are neither shuffled nor sorted."""
    return pairs.filter(F.col("verified").isNull()).select(
        "id", F.col("company_name").alias("company"), F.col("company_ticker").alias("ticker"), "kind", F.coalesce("event_text", F.lit("")).alias("event_text")
    )


def merge_profiles(company: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated columns (ticker, website, one_liner, impact, and impact_sources where given) over
    the company rows."""
    extra = [c for c in ("website", "one_liner", "impact", "impact_sources") if c in curated.columns]
    given = curated.select("ticker", *[F.col(c).alias(f"_{c}") for c in extra], F.lit(True).alias("_given"))
    joined = company.join(given, "ticker", "left")
    before = {c: F.col(c) if c in company.columns else F.lit(None) for c in extra}
    pick = {c: F.when(F.col("_given"), F.col(f"_{c}")).otherwise(before[c]) for c in extra}
    return joined.withColumns(pick).drop("_given", *[f"_{c}" for c in extra])


def run_metrics(items: DataFrame, stage: str, most_errors: int = 100) -> DataFrame:
    """One row per run of a stage from its items (run_id, at, error): what was found and what
    failed; a run with any error has failed. `errors` lists the first `most_errors` distinct texts
    in alphabetical order, `distinct_errors` counts them all."""
    counted = items.groupBy("run_id", "error").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n")
    )
    failed = F.col("error").isNotNull()
    failures = F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0))
    per_run = counted.groupBy("run_id").agg(
        F.min("first_at").alias("started_at"), F.max("last_at").alias("completed_at"),
        F.coalesce(F.sum(F.when(~failed, F.col("n"))), F.lit(0)).alias("items_found"),
        failures.alias("items_failed"), F.count_if(failed).alias("distinct_errors"),
        F.when(failures > 0, "failed").otherwise("completed").alias("status"),
    )
    first = Window.partitionBy("run_id").orderBy("error")
    listed = (
        counted.filter(failed)
        .select("run_id", "error", F.row_number().over(first).alias("_n"))
        .filter(F.col("_n") <= most_errors)
        .groupBy("run_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))
        .withColumnRenamed("run_id", "_run")
    )
    return per_run.join(listed, F.col("run_id").eqNullSafe(F.col("_run")), "left").select(
        F.lit(stage).alias("stage"), "run_id", "started_at", "completed_at", "items_found", "items_failed",
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), "distinct_errors", "status",
    )


def discover_candidates(feeds: list[DataFrame], known: DataFrame) -> DataFrame:
    """Union of feeds in order of trust; per address the first feed wins; known ones drop."""
    ranked = None
    for rank, feed in enumerate(feeds):
        part = feed.withColumn("feed_rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part)
    return insert_if_new(known, ranked, ["source_url"], [F.asc("feed_rank"), F.asc("label")])


def dedupe_by_hash(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """Fetched files (path, content) whose content was never seen, one per content."""
    hashed = files.withColumn("hash", F.sha2("content", 256)).drop("content")
    return insert_if_new(ingested, hashed, ["hash"], [F.asc("path")])
