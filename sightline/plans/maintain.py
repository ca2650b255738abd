"""Stored correlations kept up to date by batches of changed events and trades.

What a trade's pairs are depends on the trade and on the events inside its window alone. So a batch
names the trades that it can touch: those of a company that a changed event is linked to, directly
or by a topic, on the days that see it. The store is partitioned by trade month, and a batch reads and
replaces the months of the touched trades and no others. While the touched trades are few, only these are
scored again and the other pairs of their months are kept; a batch that touches more scores the trades of these
months again, which is less than to find the pairs to keep among all: no pair is shuffled then.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring as S
from ..operators.intervals import window_join
from ..operators.upserts import PAIR, upsert_correlations
from ..session import cut_lineage, new_folder
from .correlate import correlate

VERDICT = ["verified", "reason"]
# Touched trades, and pairs with a verdict (some 20 and 60 bytes each), that are sent to every task.
FEW_TRADES = FEW_VERDICTS = 1_000_000
# Months that one task writes at once; beyond it its pairs are sorted by month first.
OPEN_MONTHS = 240


def touched_trades(
    trade: DataFrame, company: DataFrame, mention: DataFrame, target: DataFrame, changed: DataFrame, *, before: int = S.WINDOW_BEFORE, after: int = S.WINDOW_AFTER
) -> DataFrame:
    """(trade_id) of the trades whose window holds a changed event (kind, event_id, event_date) of their
    company or of one of its topics. An event that has moved is in `changed` with both dates, and a
    link that has gone is still in `mention` or `target`."""
    event = lambda kind: changed.where(F.col("kind") == kind).select("event_id", "event_date")
    links = (
        mention.select(F.col("statement_id").alias("event_id"), "company_id", F.col("sector").alias("topic"))
        .join(event("statement"), "event_id")
        .unionByName(target.select(F.col("action_id").alias("event_id"), "company_id", F.col("sector").alias("topic")).join(event("action"), "event_id"))
        .select("company_id", "topic", "event_date")
        .distinct()
    )
    # days that see an event of a topic are few, whatever the companies and events; only trades that no topic
    # touches meet the events of their company
    sees = F.sequence(F.date_sub("event_date", after), F.date_add("event_date", before))
    seen_topics = (
        links.where("topic IS NOT NULL").select("topic", "event_date").distinct()
        .select("topic", F.explode(sees).alias("date"))
        .groupBy("date").agg(F.collect_set("topic").alias("_seen"))
    )
    topics = company.select(F.col("id").alias("company_id"), "topics")
    rows = (
        trade.select("id", "company_id", "date").join(topics, "company_id", "left").join(seen_topics, "date", "left")
        .select("id", "company_id", "date", F.coalesce(F.arrays_overlap("topics", "_seen"), F.lit(False)).alias("_topical"))
    )
    rest = rows.where("NOT _topical")
    direct = links.where("company_id IS NOT NULL").select("company_id", "event_date").distinct()
    days = rest.select("company_id", F.col("date").alias("trade_date")).distinct()
    seen = window_join(days, direct, ["company_id"], "trade_date", "event_date", before, after).select("company_id", F.col("trade_date").alias("date")).distinct()
    touched = rows.where("_topical").select("id").unionByName(rest.join(seen, ["company_id", "date"], "left_semi").select("id"))
    return touched.select(F.col("id").alias("trade_id"))


def _schema(pairs: DataFrame) -> T.StructType:
    kept = [f for f in pairs.schema.fields if f.name not in VERDICT]
    return T.StructType([*kept, T.StructField("verified", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("month", T.DateType())])


def stored_pairs(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The stored pairs with their verdicts; none before the first batch."""
    try:
        rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" or schema is None:
            raise
        return spark.createDataFrame([], schema)
    return rows.where("trade_id IS NOT NULL")


def refresh(
    path: str, trade: DataFrame, filing: DataFrame, company: DataFrame, person: DataFrame, statement: DataFrame, mention: DataFrame, action: DataFrame,
    target: DataFrame, *, changed: DataFrame, changed_trades: DataFrame | None = None, gone_links: tuple[DataFrame, DataFrame] | None = None, **options,
) -> DataFrame:
    """Bring the store at `path` up to date after a batch; returns the touched trades (trade_id, month).

    The entity frames are as they are after the batch. `changed` (kind, event_id, event_date) are the
    events whose rows, links or gates have changed; `changed_trades` (trade_id) are new or changed
    trades, and `gone_links` rows of mention and target that are no more. Verdicts stay with pairs that
    are still produced. A touched month is always written, if need be with a row without a trade, so
    that no pair of before is left in it; the batch may be run again. A changed trade date leaves its
    old month only if the trade's old month is touched too; give such a trade a new id.
    """
    spark = trade.sparkSession
    window = {k: options[k] for k in ("before", "after") if k in options}
    seen_mention, seen_target = mention, target
    if gone_links:
        seen_mention = mention.unionByName(gone_links[0], allowMissingColumns=True)
        seen_target = target.unionByName(gone_links[1], allowMissingColumns=True)
    touched = touched_trades(trade, company, seen_mention, seen_target, changed, **window)
    if changed_trades is not None:
        touched = touched.unionByName(changed_trades.select("trade_id")).distinct()
    months = trade.select(F.col("id").alias("trade_id"), F.trunc("date", "month").alias("month"))
    touched = cut_lineage(touched.join(months, "trade_id"))
    in_months = F.broadcast(cut_lineage(touched.select("month").distinct()))
    few = _at_most(touched, FEW_TRADES)
    if few:
        ids = F.broadcast(touched.select("trade_id"))
        mine = trade.join(ids.withColumnRenamed("trade_id", "id"), "id", "left_semi")
    else:
        mine = trade.join(in_months, F.trunc("date", "month") == F.col("month"), "left_semi")
    fresh = correlate(mine, filing, company, person, statement, mention, action, target, carry=["date"], **options)
    fresh = fresh.withColumn("_month", F.trunc("trade_date", "month")).drop("trade_date")
    schema = _schema(fresh.drop("_month"))
    before = stored_pairs(spark, path, schema).join(in_months, "month", "left_semi")
    said = cut_lineage(before.where("verified IS NOT NULL OR reason IS NOT NULL").select(*PAIR, *VERDICT))
    if _at_most(said, FEW_VERDICTS):
        said = F.broadcast(said)
    now = upsert_correlations(said, fresh).withColumnRenamed("_month", "month").select(*schema.names)
    if few:
        kept = before.join(ids, "trade_id", "left_anti").select(*schema.names)
        # the months are read and replaced, so they are complete before the first file goes
        staged = new_folder(spark, "months")
        now.unionByName(kept).write.parquet(staged)
        now = spark.read.schema(schema).parquet(staged)
    _replace_months(now.unionByName(in_months, allowMissingColumns=True), path)
    return touched


def _at_most(rows: DataFrame, n: int) -> bool:
    return rows.limit(n + 1).count() <= n


def _replace_months(rows: DataFrame, path: str) -> None:
    """Write the months in `rows` anew. A task keeps a file open for each month it meets, so its pairs
    need not be sorted by month."""
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    usual = conf.get(name)
    conf.set(name, OPEN_MONTHS)
    try:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    finally:
        conf.set(name, usual)


def review(path: str, verdicts: DataFrame) -> None:
    """Store verdicts (trade_id, kind, event_id, verified, reason) on pairs, in the months of those pairs."""
    spark = verdicts.sparkSession
    rows = spark.read.parquet(path)
    months = rows.join(verdicts.select(*PAIR), PAIR, "left_semi").select("month").distinct()
    given = verdicts.select(*PAIR, F.struct(*VERDICT).alias("_given"))
    joined = rows.join(months, "month", "left_semi").join(given, PAIR, "left")
    said = {c: F.when(F.col("_given").isNotNull(), F.col(f"_given.{c}")).otherwise(F.col(c)) for c in VERDICT}
    now = cut_lineage(joined.withColumns(said).select(*rows.columns))
    now.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
