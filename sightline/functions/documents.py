"""Fields of web pages, routing of communications and document classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dates, fixed
from .text import communication_class, html_to_text, single_speaker


def _group(html: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL when there is no match or nothing in it."""
    return F.nullif(F.regexp_extract(html, pattern, group), F.lit(""))


def page_title(html: Column, *, site: str | None = None) -> Column:
    """Main heading, else the window title; the part after the last bar is the site name."""
    heading = _group(html, r"(?is)<h1[^>]*>(.*?)</h1>")
    window = _group(html, r"(?is)<title>(.*?)(?:\s*\|[^|]*)?</title>")
    title = html_to_text(F.coalesce(heading, window))
    if site:
        title = F.trim(F.regexp_replace(title, rf"(?i)\s*[–|]\s*{site}\s*$", ""))
    return F.nullif(title, F.lit(""))


def page_fields(
    pages: DataFrame,
    *,
    person_pattern: str,
    date_pattern: str,
    body_pattern: str,
    min_body: int = fixed.MIN_BODY,
) -> DataFrame:
    """(page_id, url, html) to title, date, person and body, for pages where the required
    parts are there and the body is long enough. Patterns name the blocks of the publisher;
    without a date block the whole page is searched."""
    block = F.coalesce(_group(F.col("html"), date_pattern), F.col("html"))
    parts = pages.select(
        "page_id", "url",
        page_title(F.col("html")).alias("title"),
        html_to_text(F.coalesce(_group(F.col("html"), person_pattern), F.lit(""))).alias("person"),
        dates.long_date(html_to_text(block)).alias("date"),
        html_to_text(F.coalesce(_group(F.col("html"), body_pattern), F.lit(""))).alias("body"),
    )
    return parts.filter(
        F.col("title").isNotNull() & F.col("date").isNotNull() & (F.length("body") >= min_body)
    )


def links(pages: DataFrame, pattern: str, exclude: str | None = None) -> DataFrame:
    """Distinct link targets of each page that match a pattern (group 1 is the target)."""
    found = pages.select(
        "page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("link")
    )
    return found.filter(~F.col("link").rlike(exclude)) if exclude else found


def by_speaker(documents: DataFrame, person: str, floor: str | None = None) -> DataFrame:
    """Documents of the tracked speaker with one-speaker titles, from a day on."""
    kept = documents.filter(F.col("person").rlike(f"(?i){person}"))
    if floor:
        kept = kept.filter(F.col("date") >= F.lit(floor).cast("date"))
    return kept.withColumn("single_speaker", single_speaker(F.col("title")))


def route_communications(documents: DataFrame, *, publisher: str, subject: str) -> DataFrame:
    """Communications (doc_id, url, title, date, body) with where they go: remarks of the
    subject are statements, other remarks are dropped, the rest are actions. Too short or
    incomplete ones are dropped; the summary is cut as the reading side expects."""
    kind = communication_class(F.col("url"), publisher)
    remarks = F.col("category") == f"{publisher}_remarks"
    own = F.col("title").rlike(f"(?i){subject}")
    return (
        documents.withColumn("category", kind)
        .withColumn("summary", F.substring("body", 1, fixed.MAX_SUMMARY))
        .filter(F.col("title").isNotNull() & F.col("date").isNotNull())
        .filter(F.length("summary") >= fixed.MIN_SUMMARY)
        .filter(~remarks | own)
        .withColumn("destination", F.when(remarks, "statement").otherwise("action"))
        .withColumn("confidence", F.when(remarks, 0.85))
    )


def length_gate(documents: DataFrame) -> DataFrame:
    """Texts (doc_id, venue, text) long enough to keep, cut to the stored sizes, with the
    strongest form they qualify for."""
    size = F.length("text")
    form = (
        F.when(size >= fixed.MIN_REMARKS, "remarks")
        .when(size >= fixed.MIN_BODY, "statement")
        .when(size >= fixed.MIN_SUMMARY, "action")
    )
    limit = F.when(F.col("form") == "action", fixed.MAX_SUMMARY).otherwise(fixed.MAX_TEXT)
    return (
        documents.withColumn("form", form)
        .filter(F.col("form").isNotNull())
        .withColumn("venue", F.substring("venue", 1, fixed.MAX_VENUE))
        .withColumn("text", F.substring(F.col("text"), F.lit(1), limit))
    )
