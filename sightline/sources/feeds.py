"""Landed feeds to typed rows. Schemas are stated, never inferred; what cannot be read is
NULL or quarantined, never an error that stops the job."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, fixed
from ..functions.numeric import half_up
from ..functions.text import action_type_of_title, content_key, post_to_text, trimmed
from ..operators.resolve import first_recipient_matches
from ..operators.upserts import insert_if_new

RECORD_SCHEMA = (
    "source string, date string, ticker string, description string, type string, "
    "amount_min string, amount_max string"
)
POST_SCHEMA = "id string, created_at string, content string, url string, text string"
DOCUMENT_PAGE_SCHEMA = (
    "count bigint, next_page_url string, results array<struct<document_number: string, title: string, "
    "type: string, publication_date: string, signing_date: string, abstract: string, html_url: string>>"
)
AWARD_PAGE_SCHEMA = (
    "results array<struct<`Award ID`: string, `Recipient Name`: string, `Start Date`: string, "
    "`Award Amount`: double, `Awarding Agency`: string, generated_internal_id: string>>"
)
# Where award rows of the reading side point to, and offsets above this are
# milliseconds.
AWARD_SITE, MILLISECONDS_FROM = "https://www.usaspending.gov", 100_000


def parse_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text lines (value) to records and unreadable lines. Blank lines and records without
    source or date vanish, as does JSON that is no record; a line that is no JSON is kept whole.
    Amounts may be printed as numbers or text; one that is neither is NULL."""
    parsed = lines.select(trimmed(F.col("value")).alias("line")).filter(F.col("line") != "")
    readable = F.try_parse_json("line").isNotNull()
    bad = parsed.filter(~readable).select(F.col("line").alias("bad_line"))
    good = parsed.filter(readable & F.startswith("line", F.lit("{"))).select(F.from_json("line", RECORD_SCHEMA).alias("record")).select("record.*")
    amounts = {c: F.col(c).try_cast("decimal(38,6)").try_cast("bigint") for c in ("amount_min", "amount_max")}
    present = (F.coalesce("source", F.lit("")) != "") & (F.coalesce("date", F.lit("")) != "")
    return good.withColumns(amounts).filter(present), bad


def scan_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_records(spark.read.text(path))


def parse_posts(posts: DataFrame, source: str = "posts") -> DataFrame:
    """Posts with optional fields to statements; empty and undated ones vanish."""
    created = F.coalesce(
        F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]")),
        F.try_to_timestamp("created_at"),
    )
    return (
        posts.withColumn("body", post_to_text(F.coalesce("content", "text", F.lit(""))))
        .withColumn("spoken_at", created.cast("date"))
        .filter((F.length("body") >= 4) & F.col("spoken_at").isNotNull())
        .select(
            F.col("id").alias("source_ref"), "spoken_at", F.col("body").alias("full_text"), F.col("url").alias("source_url"),
            content_key(source, F.coalesce("id", "body")).alias("content_hash"),
        )
    )


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of posts per file."""
    return parse_posts(spark.read.schema(POST_SCHEMA).option("multiLine", True).json(path))


def parse_document_pages(pages: DataFrame, source: str) -> DataFrame:
    """Pages of a document list (json) to actions."""
    docs = pages.select(F.explode(F.from_json("json", DOCUMENT_PAGE_SCHEMA).getField("results")).alias("doc")).select("doc.*")
    return docs.select(
        action_type_of_title(F.col("title")).alias("action_type"),
        F.try_to_date("publication_date", "yyyy-MM-dd").alias("occurred_on"),
        F.try_to_date("signing_date", "yyyy-MM-dd").alias("signed_on"),
        "title",
        F.col("abstract").alias("summary"),
        F.lit(source).alias("source"),
        F.col("document_number").alias("source_ref"),
        F.col("html_url").alias("source_url"),
    )


def parse_awards(pages: DataFrame) -> DataFrame:
    """Pages of award rows (json) to contract actions with a worded title and summary."""
    rows = pages.select(F.explode(F.from_json("json", AWARD_PAGE_SCHEMA).getField("results")).alias("a")).select(
        F.coalesce("a.`Award ID`", "a.generated_internal_id").alias("award_id"),
        F.coalesce("a.`Recipient Name`", F.lit("")).alias("recipient"),
        F.col("a.`Start Date`").alias("start"),
        F.col("a.`Award Amount`").alias("amount"),
        F.coalesce("a.`Awarding Agency`", F.lit("federal agency")).alias("agency"),
        F.col("a.generated_internal_id").alias("internal_id"),
    )
    who = F.concat(F.col("recipient"), F.lit(" by "), F.col("agency"), F.lit("."))
    worth = F.concat(F.lit("Prime contract award of $"), F.format_number(half_up(F.col("amount")), 0), F.lit(" to "), who)
    page = F.concat(F.lit(f"{AWARD_SITE}/award/"), F.replace(F.url_encode("internal_id"), F.lit("+"), F.lit("%20")))
    return rows.filter(F.col("award_id").isNotNull() & F.col("start").isNotNull()).select(
        F.lit("contract").alias("action_type"),
        F.try_to_date(F.substring("start", 1, 10), "yyyy-MM-dd").alias("occurred_on"),
        "recipient",
        F.concat(F.lit("Federal contract: "), "recipient", F.lit(" — "), "agency", F.lit(" ("), "award_id", F.lit(")")).alias("title"),
        F.coalesce(worth, F.concat(F.lit("Prime contract award to "), who)).alias("summary"),
        F.lit("awards").alias("source"),
        F.coalesce("internal_id", F.concat(F.lit("award:"), "award_id")).alias("source_ref"),
        F.coalesce(page, F.lit(f"{AWARD_SITE}/search")).alias("source_url"),
    )


def link_contracts(awards: DataFrame, company: DataFrame, action: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New contract actions of accepted recipients, and their links to companies. An award
    that several companies match goes to the one with the smallest id."""
    accepted = first_recipient_matches(company, awards)
    new = insert_if_new(action, accepted, ["source", "source_ref"], [F.asc("company_id")])
    targets = new.select(
        "source", "source_ref", "company_id",
        F.lit("contract_recipient").alias("link_method"), F.lit(0.8).alias("confidence"),
    )
    return new.drop("company_id"), targets


def flatten_view_entries(payload: DataFrame) -> DataFrame:
    """View exports (json with `viewentry[]`) to (unid, columns[]): every column value as
    trimmed text in order, whichever shape it has."""
    shape = "viewentry array<struct<`@unid`: string, entrydata: string>>"
    entries = payload.select(F.posexplode(F.from_json("json", shape).getField("viewentry")).alias("at", "entry")).select(
        F.col("entry.`@unid`").alias("unid"), F.col("entry.entrydata").alias("data")
    )
    named = entries.filter(F.coalesce("unid", F.lit("")) != "")
    return named.select("unid", flatten_values(F.col("data")).alias("columns"))


# Keys that hold the content of a value, in order of preference.
CONTENT_KEYS = ["text", "datetime", "textlist", "number"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _leaves(values: pd.Series) -> pd.Series:
    """Leaves of JSON values at any depth; text that is no JSON is its own leaf."""

    def opened(text: str | None) -> list[str]:
        try:
            waiting = [json.loads(text, parse_int=str, parse_float=str)]
        except (TypeError, ValueError, RecursionError):
            return [text] if text is not None else []
        found: list[str] = []
        while waiting:
            value = waiting.pop()
            if isinstance(value, dict):
                chosen = next((value[k] for k in CONTENT_KEYS if value.get(k) is not None), None)
                value = [chosen] if chosen is not None else list(value.values())
            if isinstance(value, list):
                waiting.extend(reversed(value))
            elif value is not None:
                found.append(str(value).lower() if isinstance(value, bool) else value)
        return found

    return values.map(opened)


def flatten_values(json_text: Column) -> Column:
    """All leaves of a JSON value in order, at any depth. Objects contribute one of their content
    keys, else all their values."""
    texts = F.transform(_leaves(json_text), lambda v: trimmed(v))
    return F.filter(texts, lambda v: v.isNotNull() & (v != ""))


def filer_candidates(entries: DataFrame, filer: str) -> DataFrame:
    """View entries (unid, columns[]) that are a tracked filer's disclosure form."""
    joined = F.array_join("columns", " | ")
    pdf = F.filter("columns", lambda c: c.rlike(r"(?i)\.pdf$"))
    named = F.filter("columns", lambda c: c.rlike(f"(?i){filer}"))
    return (
        entries.withColumn("joined", joined)
        .filter(F.col("joined").rlike(f"(?i){filer}") & F.col("joined").contains("278"))
        .withColumn("filing_date", dates.iso_or_us_date(F.col("joined")))
        .filter(F.col("filing_date").isNotNull())
        .select(
            "unid",
            F.coalesce(F.substring(F.try_element_at(named, F.lit(1)), 1, 120), F.lit("tracked filer")).alias("filer_name"),
            F.when(F.col("joined").rlike(r"(?i)278[\s-]*T"), "278-T").otherwise("278e").alias("form_type"),
            "filing_date",
            F.try_element_at(pdf, F.lit(1)).alias("file_name"),
        )
    )


def normalize_captions(payload: DataFrame) -> DataFrame:
    """Caption payloads (video_id, json), a list or an object around one, to segments
    (video_id, idx, text, start) in seconds."""
    item = "struct<text: string, offset: string, start: string, startTime: string>"
    wrapped = F.from_json("json", f"content array<{item}>, transcript array<{item}>, segments array<{item}>")
    plain = F.substring(F.ltrim("json"), 1, 1) == "["
    listed = F.when(plain, F.from_json("json", f"array<{item}>")).otherwise(
        F.coalesce(wrapped["content"], wrapped["transcript"], wrapped["segments"])
    )
    raw = F.coalesce(F.coalesce("seg.offset", "seg.start", "seg.startTime").try_cast("double"), F.lit(0.0))
    rows = (
        payload.select("video_id", F.posexplode(listed).alias("at", "seg"))
        .select("video_id", "at", trimmed(F.col("seg.text")).alias("text"), raw.alias("raw"))
        .filter(F.coalesce("text", F.lit("")) != "")
    )
    return rows.select(
        "video_id", F.col("at").alias("idx"), "text",
        F.when(F.col("raw") > MILLISECONDS_FROM, F.col("raw") / 1000).otherwise(F.col("raw")).alias("start"),
    )


def segment_speakers(segments: DataFrame, labels: DataFrame, subject: str, gate: float = 0.8) -> DataFrame:
    """Segments (video_id, idx, text) with labels (video_id, idx, speaker, confidence) to the
    subject's trusted and to-be-reviewed text in order. Others are never attributed."""
    own = segments.join(labels, ["video_id", "idx"]).filter(F.col("speaker") == subject)
    sure = F.col("confidence") >= gate
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text", sure.alias("sure"))))
    pick = lambda keep: F.array_join(
        F.transform(F.filter("parts", lambda p: p["sure"] == keep), lambda p: p["text"]), " "
    )
    assembled = own.groupBy("video_id").agg(
        ordered.alias("parts"), F.min(F.when(sure, F.col("confidence"))).alias("least")
    )
    return assembled.select(
        "video_id", pick(True).alias("trusted"), pick(False).alias("review"),
        F.coalesce("least", F.lit(0.0)).alias("min_confidence"),
    )


def gate_transcripts(assembled: DataFrame) -> DataFrame:
    """Which text of a recording is stored: trusted if long enough, else the uncertain one,
    marked for review."""
    trusted = F.length("trusted") >= fixed.MIN_REMARKS
    review = F.length("review") >= fixed.MIN_REMARKS
    return assembled.filter(trusted | review).select(
        "video_id",
        F.substring(F.when(trusted, F.col("trusted")).otherwise(F.col("review")), 1, fixed.MAX_TEXT).alias("full_text"),
        F.when(trusted, F.col("min_confidence")).otherwise(0.5).alias("confidence"),
        F.when(~trusted, True).alias("needs_review"),
    )


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Fetched files below a folder as (path, content); the names keep their place in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content")
