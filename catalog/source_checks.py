"""Feeds, pages, documents and exports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions import bands, dates, documents, text
from sightline.functions import fixed
from sightline.operators.listing import trade_view
from sightline.session import shared_folder
from sightline.sources import exports, feeds, pages

from .bindings import with_entities
from .registry import check


def _folder(b, name: str) -> str:
    """A new folder for one written table, reachable by every executor."""
    return os.path.join(shared_folder(b.spark), f"{name}-{uuid.uuid4().hex}")


# --- feeds --------------------------------------------------------------------------------


def _record_lines(b):
    trade = b.trade
    record = F.to_json(
        F.struct(
            F.when(F.col("id") % 7 != 0, F.lit("alpha")).alias("source"),
            F.date_format("date", "yyyy-MM-dd").alias("date"),
            F.concat(F.lit("S"), "company_id").alias("ticker"), "description", "type", "amount_min", "amount_max",
        )
    )
    line = (
        F.when(F.col("id") % 10 == 3, F.concat(F.lit("{broken "), "id"))
        .when(F.col("id") % 10 == 5, F.lit("   "))
        .when(F.col("id") % 10 == 7, F.regexp_replace(record, r'("amount_m[a-z]+":)(\d+)', r"$1$2.0"))
        .when(F.col("id") % 10 == 9, F.regexp_replace(record, r'("amount_m[a-z]+":)(\d+)', r'$1"$2"'))
        .otherwise(F.concat(F.lit("  "), record))
    )
    other = trade.select(F.lit("5").alias("value")).union(trade.select(F.lit("[1]")))
    return trade.select(line.alias("value")).union(other)


@check("scan_ndjson_quarantine", with_entities("""
SELECT 'record' AS part, ticker AS key, count(*) AS n, CAST(sum(amount_min) AS BIGINT) AS total FROM (
  SELECT *, 'S' || company_id AS ticker FROM trade WHERE id % 10 NOT IN (3, 5) AND id % 7 <> 0) GROUP BY ticker
UNION ALL SELECT 'bad', '{broken ' || id, count(*), NULL FROM trade WHERE id % 10 = 3 GROUP BY id"""))
def scan_ndjson_quarantine(b):
    path = _folder(b, "records")
    _record_lines(b).write.text(path)
    good, bad = feeds.scan_records(b.spark, path)
    kept = good.groupBy(F.col("ticker").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_min").alias("total")
    )
    lost = bad.groupBy(F.col("bad_line").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return kept.withColumn("part", F.lit("record")).unionByName(
        lost.withColumns({"part": F.lit("bad"), "total": F.lit(None).cast("bigint")})
    )


@check("ingest_posts", """
SELECT CAST(doc_id AS VARCHAR) AS source_ref, strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') AS spoken_at,
  md5(body) AS body_key, 'https://posts.example/' || doc_id AS source_url, sha256('posts:' || doc_id) AS content_hash
FROM (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10)) || ' & "' || chr(10), '[ \\t]+', ' ', 'g'),
  '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g') AS body FROM documents WHERE doc_id % 8 <> 1)
WHERE length(body) >= 4""")
def ingest_posts(b):
    doc = F.col("doc_id")
    html = F.concat(F.lit("<p>"), F.replace("text", F.lit("\n"), F.lit("<br/></p>")), F.lit(" &amp; &quot;</p><img src=x>"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (doc % 300).cast("int"))
    posts = b.table("documents").select(
        doc.cast("string").alias("id"),
        F.when(doc % 8 == 1, F.lit("not a date")).otherwise(
            F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T13:45:10.500Z"))
        ).alias("created_at"),
        F.when(doc % 2 == 0, html).alias("content"),
        F.concat(F.lit("https://posts.example/"), doc).alias("url"),
        F.when(doc % 2 == 1, html).alias("text"),
    )
    # posts too short to be statements vanish
    short = posts.withColumns({"id": F.concat(F.lit("-"), "id"), "content": F.lit("ok"), "text": F.lit(None).cast("string")})
    # one JSON array of some hundred posts per file, as feeds are landed
    path = _folder(b, "posts")
    bundle = posts.unionByName(short).groupBy(F.floor(F.abs(F.col("id").cast("bigint")) / 100)).agg(F.collect_list(F.struct(*posts.columns)).alias("items"))
    bundle.select(F.to_json("items").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = feeds.read_posts(b.spark, path)
    return rows.select("source_ref", "spoken_at", F.md5("full_text").alias("body_key"), "source_url", "content_hash")


@check("ingest_documents", with_entities("""
SELECT CAST(o_orderkey AS VARCHAR) AS source_ref, 'register' AS source,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'executive_order' WHEN '2-HIGH' THEN 'proclamation' WHEN '3-MEDIUM' THEN 'notice' WHEN '4-NOT SPECIFIED' THEN 'determination' ELSE 'presidential_document' END AS action_type,
  strftime(o_orderdate, '%Y-%m-%d') AS occurred_on, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS signed_on
FROM orders"""))
def ingest_documents(b):
    order, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    title = (
        F.when(priority == "1-URGENT", F.concat(F.lit("Executive Order "), order))
        .when(priority == "2-HIGH", F.concat(F.lit("PROCLAMATION "), order))
        .when(priority == "3-MEDIUM", F.concat(F.lit("Public Notice "), order))
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit("A Determination "), order))
        .otherwise(F.concat(F.lit("Order "), order))
    )
    doc = F.struct(
        order.cast("string").alias("document_number"), title.alias("title"), F.lit("X").alias("type"),
        day.alias("publication_date"), F.when(order % 3 == 0, day).otherwise("none").alias("signing_date"),
        F.lit(None).cast("string").alias("abstract"), F.lit("https://register.example/").alias("html_url"),
    )
    listing = b.table("orders").groupBy(F.floor(order / 100).alias("page")).agg(F.collect_list(doc).alias("results"))
    pages_json = listing.select(F.to_json(F.struct(F.lit(1).alias("count"), "results")).alias("json"))
    rows = feeds.parse_document_pages(pages_json, "register")
    return rows.select("source_ref", "source", "action_type", "occurred_on", "signed_on")


def _award_pages(b):
    part = F.col("p_partkey")
    award = F.struct(
        F.when(part % 4 != 0, F.concat(F.lit("A-"), part)).alias("Award ID"),
        F.concat(F.lit("The "), "p_name", F.lit(" "), "p_type", F.lit(" Group")).alias("Recipient Name"),
        F.when(part % 9 != 0, F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (part % 400).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00"))).alias("Start Date"),
        F.when(part % 5 != 0, F.col("p_retailprice") * 1000 + 0.5).alias("Award Amount"),
        F.when(part % 7 != 0, F.concat(F.lit("Agency "), "p_brand")).alias("Awarding Agency"),
        F.when(part % 3 == 0, F.concat(F.lit("CONT AWD/"), part)).alias("generated_internal_id"),
    )
    listing = b.table("part").groupBy(F.floor(part / 100).alias("page")).agg(F.collect_list(award).alias("results"))
    return listing.select(F.to_json(F.struct("results")).alias("json"))


AWARD_SQL = """
award AS (
  SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN 'A-' || p_partkey END, iid) AS award_id, 'The ' || p_name || ' ' || p_type || ' Group' AS recipient,
    strftime(DATE '2024-01-01' + CAST(p_partkey % 400 AS INTEGER), '%Y-%m-%d') AS occurred_on,
    CASE WHEN p_partkey % 5 <> 0 THEN CAST(floor(p_retailprice * 1000 + 0.5 + 0.5) AS BIGINT) END AS amount,
    CASE WHEN p_partkey % 7 <> 0 THEN 'Agency ' || p_brand ELSE 'federal agency' END AS agency, iid
  FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'CONT AWD/' || p_partkey END AS iid FROM part) WHERE p_partkey % 9 <> 0),
contract AS (
  SELECT occurred_on, recipient, 'Federal contract: ' || recipient || ' — ' || agency || ' (' || award_id || ')' AS title,
    CASE WHEN amount IS NOT NULL THEN 'Prime contract award of $' || format('{:,}', amount) || ' to ' || recipient || ' by ' || agency || '.'
      ELSE 'Prime contract award to ' || recipient || ' by ' || agency || '.' END AS summary,
    coalesce(iid, 'award:' || award_id) AS source_ref,
    CASE WHEN iid IS NOT NULL THEN 'https://www.usaspending.gov/award/CONT%20AWD%2F' || p_partkey ELSE 'https://www.usaspending.gov/search' END AS source_url
  FROM award WHERE award_id IS NOT NULL)
"""


@check("ingest_awards", with_entities("WITH" + AWARD_SQL + "SELECT * FROM contract"))
def ingest_awards(b):
    return feeds.parse_awards(_award_pages(b)).select("occurred_on", "recipient", "title", "summary", "source_ref", "source_url")


@check("link_contracts", with_entities("WITH" + AWARD_SQL + """
SELECT a.source_ref, min(c.id) AS company_id, 'contract_recipient' AS link_method, 0.8::DOUBLE AS confidence
FROM contract a JOIN (SELECT s_suppkey AS id, [w FOR w IN string_split(upper(p_name || ' ' || p_type), ' ') IF length(w) >= 4][1:2] AS tokens
  FROM supplier JOIN part ON p_partkey = s_suppkey) c
ON len(tokens) > 0 AND contains(upper(a.recipient), tokens[1]) AND (len(tokens) < 2 OR contains(upper(a.recipient), tokens[2]))
WHERE a.source_ref NOT LIKE 'award:%0' GROUP BY a.source_ref"""))
def link_contracts(b):
    firms = b.table("supplier").join(b.table("part"), F.col("p_partkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", F.lit("Corp")).alias("name")
    )
    awards = feeds.parse_awards(_award_pages(b))
    stored = awards.filter(F.col("source_ref").like("award:%0")).select("source", "source_ref")
    _, targets = feeds.link_contracts(awards, firms, stored)
    return targets.select("source_ref", "company_id", "link_method", "confidence")


def _view_payload(b):
    """View exports with every shape of column value, forty entries per payload."""
    order = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    us = F.date_format("o_orderdate", "M/d/yyyy")
    filer = F.when(order % 4 == 0, "Doe, Jane Q").otherwise(F.concat(F.lit("Person "), order))
    form = F.when(order % 3 == 0, "278 T").when(order % 3 == 1, "278e").otherwise("450")
    cells = [
        F.concat(F.lit('{"@name":"a","text":{"0":" '), filer, F.lit(' "}}')),
        F.concat(F.lit('{"@name":"b","text":"'), form, F.lit('"}')),
        F.concat(F.lit('{"datetime":{"0":"'), F.when(order % 2 == 0, day).otherwise(us), F.lit('"}}')),
        F.concat(F.lit('{"textlist":{"text":[{"0":"x'), order, F.lit('"},"","two"]}}')),
        F.concat(F.lit('{"number":'), order, F.lit("}")),
        F.concat(F.lit('["file'), order, F.lit('.PDF", null]')),
    ]
    unid = F.when(order % 10 != 9, F.concat(F.lit('"@unid":"U'), order, F.lit('",'))).otherwise("")
    entry = F.concat(F.lit("{"), unid, F.lit('"entrydata":['), F.concat_ws(",", *cells), F.lit("]}"))
    return b.table("orders").groupBy(F.floor(order / 40).alias("page")).agg(
        F.concat(F.lit('{"viewentry":['), F.concat_ws(",", F.collect_list(entry)), F.lit("]}")).alias("json")
    )


VIEW_SQL = """
entry AS (
  SELECT o_orderkey, 'U' || o_orderkey AS unid, CASE WHEN o_orderkey % 4 = 0 THEN 'Doe, Jane Q' ELSE 'Person ' || o_orderkey END AS filer,
    CASE o_orderkey % 3 WHEN 0 THEN '278 T' WHEN 1 THEN '278e' ELSE '450' END AS form,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE CAST(month(o_orderdate) AS VARCHAR) || '/' || day(o_orderdate) || '/' || year(o_orderdate) END AS printed,
    strftime(o_orderdate, '%Y-%m-%d') AS filing_date
  FROM orders WHERE o_orderkey % 10 <> 9)
"""


@check("flatten_view_entries", with_entities("WITH" + VIEW_SQL + """
SELECT unid, concat_ws('|', filer, form, printed, 'x' || o_orderkey, 'two', o_orderkey, 'file' || o_orderkey || '.PDF') AS columns FROM entry"""))
def flatten_view_entries(b):
    return feeds.flatten_view_entries(_view_payload(b))


@check("filer_candidates", with_entities("WITH" + VIEW_SQL + """
SELECT unid, filer AS filer_name, CASE form WHEN '278 T' THEN '278-T' ELSE '278e' END AS form_type, filing_date, 'file' || o_orderkey || '.PDF' AS file_name
FROM entry WHERE o_orderkey % 4 = 0 AND (form <> '450' OR CAST(o_orderkey AS VARCHAR) LIKE '%278%')"""))
def filer_candidates(b):
    entries = feeds.flatten_view_entries(_view_payload(b))
    return feeds.filer_candidates(entries, r"doe,?\s+jane")


def _captions(b):
    conv, turn = F.col("conv_id"), F.col("turn")
    start = F.when(conv % 2 == 0, turn * 7).otherwise(turn * 90_000 + 50_000)
    item = F.struct("turn", F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("text"), start.alias("s"))
    rows = b.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def as_json(key: str):
        named = F.transform("items", lambda i: F.struct(i["text"].alias("text"), i["s"].alias(key)))
        return F.to_json(named)

    wrapped = lambda name, key: F.concat(F.lit(f'{{"{name}":'), as_json(key), F.lit("}"))
    json = (
        F.when(conv % 4 == 0, as_json("offset"))
        .when(conv % 4 == 1, wrapped("content", "start"))
        .when(conv % 4 == 2, wrapped("transcript", "startTime"))
        .otherwise(wrapped("segments", "offset"))
    )
    return rows.select(conv.alias("video_id"), json.alias("json"))


CAPTION_SQL = """
caption AS (
  SELECT conv_id AS video_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS idx,
    regexp_replace(text, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g') AS text, role, turn,
    CASE WHEN conv_id % 2 = 0 THEN (turn * 7)::DOUBLE WHEN turn * 90000 + 50000 > 100000 THEN (turn * 90000 + 50000) / 1000.0::DOUBLE ELSE (turn * 90000 + 50000)::DOUBLE END AS start
  FROM conversations)
"""


@check("normalize_captions", with_entities("WITH" + CAPTION_SQL + "SELECT video_id, idx, text, start FROM caption WHERE text <> ''"))
def normalize_captions(b):
    return feeds.normalize_captions(_captions(b))


def _speakers(b):
    segments = b.table("conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"), "text")
    role = F.col("role")
    labels = b.table("conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"),
        F.when(role == "user", "SUBJECT").when(role == "assistant", "OTHER").otherwise("UNCERTAIN").alias("speaker"),
        (F.lit(0.5) + (F.col("conv_id") * 7 + F.col("turn") * 13) % 50 / 100).alias("confidence"),
    ).dropDuplicates(["video_id", "idx"])
    return feeds.segment_speakers(segments, labels, "SUBJECT")


SPEAKER_SQL = """
spoken AS (SELECT conv_id AS video_id, turn, text, 0.5::DOUBLE + (conv_id * 7 + turn * 13) % 50 / 100.0::DOUBLE AS confidence FROM conversations WHERE role = 'user'),
assembled AS (
  SELECT video_id, coalesce(string_agg(text, ' ' ORDER BY turn, text) FILTER (WHERE confidence >= 0.8::DOUBLE), '') AS trusted,
    coalesce(string_agg(text, ' ' ORDER BY turn, text) FILTER (WHERE confidence < 0.8::DOUBLE), '') AS review,
    coalesce(min(confidence) FILTER (WHERE confidence >= 0.8::DOUBLE), 0.0::DOUBLE) AS min_confidence FROM spoken GROUP BY video_id)
"""


@check("segment_speakers", with_entities("WITH" + SPEAKER_SQL + "SELECT * FROM assembled"))
def segment_speakers(b):
    return _speakers(b)


@check("gate_transcripts", with_entities("WITH" + SPEAKER_SQL + """
SELECT video_id, substr(CASE WHEN length(trusted) >= 200 THEN trusted ELSE review END, 1, 60000) AS full_text,
  CASE WHEN length(trusted) >= 200 THEN min_confidence ELSE 0.5::DOUBLE END AS confidence, CASE WHEN length(trusted) < 200 THEN true END AS needs_review
FROM assembled WHERE length(trusted) >= 200 OR length(review) >= 200"""))
def gate_transcripts(b):
    return feeds.gate_transcripts(_speakers(b))


# --- exports ------------------------------------------------------------------------------

EXPORT_SQL = """
SELECT t.id, t.row_number::BIGINT AS "rowNumber", strftime(t.date, '%Y-%m-%d') AS "transactionDate", t.type AS "transactionType", t.description || ', "lot"' AS "descriptionRaw",
  c.ticker, c.name AS "companyName", c.sector, t.band::BIGINT AS "amountBand", t.amount_min AS "amountMin", t.amount_max AS "amountMax",
  CASE WHEN t.id % 3 = 0 THEN t.id % 2 = 0 END AS "notificationLate", t.filing_id AS "filingId", strftime(t.filing_date, '%Y-%m-%d') AS "filingDate", t.filing_url AS "sourceUrl"
FROM public_trade t LEFT JOIN company c ON c.id = t.company_id"""
EXPORT_SCHEMA = (
    "id bigint, rowNumber int, transactionDate string, transactionType string, descriptionRaw string, ticker string, "
    "companyName string, sector string, amountBand int, amountMin bigint, amountMax bigint, notificationLate boolean, "
    "filingId bigint, filingDate string, sourceUrl string"
)


def _export_view(b):
    view = trade_view(b.trade, b.filing, b.company)
    return view.withColumns({
        "description": F.concat("description", F.lit(', "lot"')),
        "notification_late": F.when(F.col("id") % 3 == 0, F.col("id") % 2 == 0),
    })


@check("export_csv", with_entities(EXPORT_SQL))
def export_csv(b):
    path = exports.export_csv(_export_view(b), _folder(b, "csv"))
    return b.spark.read.schema(EXPORT_SCHEMA).option("header", True).option("escape", '"').csv(path)


@check("export_ndjson", with_entities(EXPORT_SQL))
def export_ndjson(b):
    path = exports.export_ndjson(_export_view(b), _folder(b, "json"))
    return b.spark.read.schema(EXPORT_SCHEMA).json(path)


# --- pages of filings -----------------------------------------------------------------------

PRINT_SQL = """
printed AS (
  SELECT filing_id, row_number, id, description, type, band, CAST(date + INTERVAL 25 YEAR AS DATE) AS day, id % 4 = 0 AS garbled, id % 3 = 0 AS late FROM described),
filing_year AS (SELECT filing_id, max(year(day)) AS y FROM printed GROUP BY filing_id),
kept AS (
  SELECT CAST(p.filing_id AS VARCHAR) AS filing, CASE WHEN row_number <= 3 THEN 1 ELSE 2 END AS page, p.* EXCLUDE (filing_id)
  FROM printed p JOIN filing_year f ON f.filing_id = p.filing_id AND year(p.day) >= f.y - 2)
"""
ROW_OUT_SQL = """
SELECT filing, page::BIGINT AS page, row_number() OVER (PARTITION BY filing ORDER BY row_number)::BIGINT AS row_number,
  description || CASE WHEN garbled AND type = 'Sale' THEN ' Salo' ELSE '' END AS description, type, strftime(day, '%Y-%m-%d') AS date, late,
  band::BIGINT AS band, amount FROM kept JOIN (VALUES (1, '$1,001 - $15,000'), (2, '$15,001 - $50,000'), (3, '$50,001 - $100,000'), (4, '$100,001 - $250,000'),
    (5, '$250,001 - $500,000'), (6, '$500,001 - $1,000,000'), (7, '$1,000,001 - $5,000,000'), (8, '$5,000,001 - $25,000,000'), (9, '$25,000,001 - $50,000,000')) v(b, amount) ON b = band
"""
HEADER = "Form 278 Transactions\nDescription Type Date Notification Amount\nReceived Over 30 Days Ago\n"


def _filing_pages(b):
    """Page texts as a recogniser prints them, from the described trades."""
    day = F.add_months("date", 300)
    garbled, kind = F.col("id") % 4 == 0, F.col("type")
    word = F.when(garbled & (kind == "Purchase"), "Ourchaso").when(garbled & (kind == "Sale"), "Salo").otherwise(kind)
    amount = F.replace(bands.band_label(F.col("band")), F.lit(" – "), F.lit(" - "))
    line = F.concat_ws(
        " ", "row_number", "description", word, F.date_format(day, "MM/dd/yyyy"),
        F.when(F.col("id") % 3 == 0, "Yes").otherwise("No"), amount,
    )
    page = F.when(F.col("row_number") <= 3, 1).otherwise(2)
    lines = b.described.select("filing_id", "row_number", page.alias("page"), line.alias("line"), F.year(day).alias("y"))
    texts = lines.groupBy("filing_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("row_number", "line"))).alias("lines"), F.max("y").alias("y")
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return texts.withColumn("filing_year", F.max("y").over(Window.partitionBy("filing_id"))).select(
        F.col("filing_id").cast("string").alias("filing"), "page", "filing_year",
        F.concat(F.lit(HEADER), body, F.lit("\nPage "), "page", F.lit(" of 2")).alias("text"),
    )


@check("extract_rows", with_entities("WITH" + PRINT_SQL + ROW_OUT_SQL))
def extract_rows(b):
    rows = pages.extract_rows(_filing_pages(b))
    return rows.select("filing", "page", "row_number", "description", "type", "date", "late", "band", "amount")


@check("page_reports", with_entities("WITH" + PRINT_SQL + """
SELECT a.filing, a.page::BIGINT AS page, coalesce(k.n, 0) AS rows_found, count(*) OVER (PARTITION BY a.filing) AS page_count, 2::BIGINT AS declared_total
FROM (SELECT DISTINCT CAST(filing_id AS VARCHAR) AS filing, CASE WHEN row_number <= 3 THEN 1 ELSE 2 END AS page FROM printed) a
LEFT JOIN (SELECT filing, page, count(*) AS n FROM kept GROUP BY ALL) k USING (filing, page)"""))
def page_reports(b):
    texts = b.written(_filing_pages(b), "pages")  # read for the rows, the facts and the totals
    reports = pages.page_reports(texts, pages.extract_rows(texts))
    return reports.select("filing", "page", "rows_found", "page_count", "declared_total")


@check("scan_pages", """
SELECT source AS filing, doc_id + 1 AS page, length(text) + 1 AS chars, md5(text || chr(10)) AS text_key FROM documents""")
def scan_pages(b):
    path = _folder(b, "pages")
    name = F.concat(F.col("source"), F.lit(".p"), F.col("doc_id"), F.lit(".txt"))
    docs = b.table("documents").select("text", name.alias("doc"))
    docs.repartition("doc").write.partitionBy("doc").text(path)
    rows = pages.scan_pages(b.spark, path)
    return rows.select("filing", F.col("page").cast("bigint").alias("page"), F.length("text").alias("chars"), F.md5("text").alias("text_key"))


@check("classify_type", with_entities("""
SELECT id, CASE WHEN w LIKE '%partial%' THEN 'Sale (Partial)' WHEN w LIKE '%purchas%' THEN 'Purchase' WHEN w LIKE '%sale%' THEN 'Sale' WHEN w LIKE '%exchang%' THEN 'Exchange'
  WHEN id % 6 = 1 THEN CASE type WHEN 'Purchase' THEN 'Purchase' WHEN 'Sale' THEN 'Sale' ELSE 'Exchange' END ELSE 'Unknown' END AS type
FROM (SELECT id, type, lower(CASE id % 6 WHEN 0 THEN type || ' (Partial)' WHEN 1 THEN '' WHEN 2 THEN 'zzz qqq' ELSE type END) AS w FROM trade)"""))
def classify_type(b):
    key, kind = F.col("id"), F.col("type")
    bent = F.when(kind == "Purchase", "Purcnase").when(kind == "Sale", "SaIe").otherwise("Excnange")
    cell = (
        F.when(key % 6 == 0, F.concat(kind, F.lit(" (Partial)"))).when(key % 6 == 1, bent)
        .when(key % 6 == 2, "zzz qqq").otherwise(kind)
    )
    rows = b.trade.select("id", F.concat(F.lit("LOT "), cell).alias("cell"))
    return pages.with_type(rows, pages.keyword_type(F.col("cell")), F.col("cell")).select("id", "type")


@check("resolve_band", with_entities("""
SELECT id, CASE WHEN id % 8 = 7 THEN NULL WHEN id % 8 = 6 THEN 10 ELSE band END::BIGINT AS band FROM trade"""))
def resolve_band(b):
    label = bands.band_label(F.col("band"))
    key = F.col("id")
    noisy = (
        F.when(key % 8 == 7, F.lit("no amount here"))
        .when(key % 8 == 6, F.concat(F.lit("0ver S50,000,000 then "), label))
        .when(key % 2 == 0, F.concat(F.lit("LOT 9 "), F.replace(F.replace(label, F.lit(","), F.lit(".")), F.lit("$"), F.lit("S"))))
        .otherwise(F.replace(label, F.lit("–"), F.lit("~")))
    )
    return b.trade.select("id", bands.band_of_text(noisy).alias("band"))


# --- documents ------------------------------------------------------------------------------

CLEAN_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x},
  '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&', 'g'), '&#8217;|&rsquo;', '''', 'g'), '&#8220;|&#8221;|&ldquo;|&rdquo;', '"', 'g'), '&nbsp;', ' ', 'g'),
  '(?i)&[a-z]+;', ' ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g')"""


def clean_sql(x: str) -> str:
    return "trim(" + CLEAN_SQL.replace("{x}", x) + ")"


NO_HEAD_SQL = "regexp_replace(html, '(?is)<head.*?</head>', ' ', 'g')"


@check("html_to_text", f"""
SELECT page_id, {clean_sql('html')} AS body, {clean_sql(NO_HEAD_SQL)} AS body_no_head FROM pages""")
def html_to_text(b):
    html = F.col("html")
    return b.table("pages").select(
        "page_id", text.html_to_text(html).alias("body"), text.html_to_text(html, drop_head=True).alias("body_no_head")
    )


# The given pages with the blocks of a transcript site around their content.
PRESS_SQL = """
press AS (
  SELECT page_id, url, strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER), '%Y-%m-%d') AS day,
    CASE page_id % 3 WHEN 0 THEN 'Jane Doe' WHEN 1 THEN 'John Roe' ELSE 'Jane Q. Doe' END AS person,
    CASE page_id % 4 WHEN 0 THEN 'Remarks' WHEN 1 THEN 'Interview' WHEN 2 THEN 'Statement' ELSE 'Notes' END AS word, html FROM pages),
press_doc AS (
  SELECT page_id, url, person, day AS date, CASE WHEN page_id % 5 = 0 THEN word || ' on the day' ELSE word || ' ' || {h1} END AS title, {body} AS body FROM press WHERE page_id % 7 <> 0)
""".replace("{h1}", clean_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")).replace(
    "{body}", clean_sql("regexp_extract(html, '(?is)<article>(.*?)</article>', 1)"))


def _press(b):
    page = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (page % 300).cast("int")), "MMMM d, yyyy")
    person = F.when(page % 3 == 0, "Jane Doe").when(page % 3 == 1, "John Roe").otherwise("Jane Q. Doe")
    word = F.when(page % 4 == 0, "Remarks").when(page % 4 == 1, "Interview").when(page % 4 == 2, "Statement").otherwise("Notes")
    heading = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    article = F.regexp_extract("html", r"(?is)<article>(.*?)</article>", 1)
    top = F.when(page % 5 == 0, F.concat(F.lit("<title>"), word, F.lit(" on the day | Some Site</title>"))).otherwise(
        F.concat(F.lit("<h1 class='t'>"), word, F.lit(" "), heading, F.lit("</h1>"))
    )
    html = F.concat(
        top, F.lit("<div class='person'><a>"), person, F.lit("</a></div><span class='date'>"),
        F.when(page % 7 == 0, "someday").otherwise(day), F.lit("</span><div class='body'>"),
        F.regexp_replace(article, "(?i)</?h1[^>]*>", " "), F.lit("</div></div>"),
    )
    raw = b.table("pages").select("page_id", "url", html.alias("html"))
    return documents.page_fields(
        raw,
        person_pattern=r"(?is)<div class='person'>(.*?)</div>",
        date_pattern=r"(?is)<span class='date'>(.*?)</span>",
        body_pattern=r"(?is)<div class='body'>(.*?)</div>\s*</div>",
    )


@check("extract_page_fields", with_entities("WITH" + PRESS_SQL + """
SELECT page_id, person, date, title, md5(body) AS body_key FROM press_doc WHERE length(body) >= 120"""))
def extract_page_fields(b):
    return _press(b).select("page_id", "person", "date", "title", F.md5("body").alias("body_key"))


@check("speaker_filter", with_entities("WITH" + PRESS_SQL + """
SELECT page_id, regexp_matches(title, '(?i)^(remarks|address|statement|message|commencement|inaugural|letter)') AND NOT regexp_matches(title,
  '(?i)(news conference|press conference|interview|exchange with reporters|question-and-answer|town hall|debate|gaggle)') AS single_speaker
FROM press_doc WHERE length(body) >= 120 AND person IN ('Jane Doe', 'Jane Q. Doe') AND date >= '2024-02-01'"""))
def speaker_filter(b):
    return documents.by_speaker(_press(b), r"jane\s+(q\.?\s+)?doe", "2024-02-01").select("page_id", "single_speaker")


@check("extract_links", """
SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href="(/[^"]+)"', 1)) AS link FROM pages)
WHERE NOT regexp_matches(link, '^/the')""")
def extract_links(b):
    return documents.links(b.table("pages"), r'(?i)href="(/[^"]+)"', "^/the")


@check("url_parts", r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS file_name FROM pages""")
def url_parts(b):
    url = F.col("url")
    return b.table("pages").select("page_id", dates.url_host(url).alias("host"), dates.url_file_name(url).alias("file_name"))


@check("classify_documents", with_entities("""
SELECT id, CASE w WHEN 'Executive Order' THEN 'executive_order' WHEN 'Proclamation' THEN 'proclamation' WHEN 'Message' THEN 'presidential_document'
    WHEN 'Remarks' THEN 'presidential_document' ELSE 'notice' END AS action_type,
  CASE w WHEN 'Message' THEN 'message' WHEN 'Remarks' THEN 'remarks' ELSE 'document' END AS channel,
  CASE id % 4 WHEN 0 THEN 'office_fact_sheet' WHEN 1 THEN 'office_remarks' WHEN 2 THEN 'office_briefing' ELSE 'office_statement' END AS class
FROM (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Executive Order' WHEN 1 THEN 'Proclamation' WHEN 2 THEN 'Message' WHEN 3 THEN 'Remarks' ELSE 'Public Notice' END AS w FROM orders)"""))
def classify_documents(b):
    return _titled(b).select(
        "id", text.action_type_of_title(F.col("title")).alias("action_type"),
        text.channel_of_title(F.col("title")).alias("channel"),
        text.communication_class(F.col("url"), "office").alias("class"),
    )


def _titled(b):
    key = F.col("o_orderkey")
    word = F.array(*[F.lit(w) for w in ("Executive Order", "Proclamation", "Message", "Remarks", "Public Notice")])
    path = F.array(*[F.lit(p) for p in ("Fact-Sheets", "remarks", "Briefings", "articles")])
    return b.table("orders").select(
        key.alias("id"),
        F.concat_ws(" ", F.element_at(word, (key % 5 + 1).cast("int")), key).alias("title"),
        F.concat_ws("/", F.lit("https://office.example"), F.element_at(path, (key % 4 + 1).cast("int")), F.lit("2025/03"), key, F.lit("")).alias("url"),
    )


@check("exclude_doc_classes", """
SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 NOT IN (0, 1)""")
def exclude_doc_classes(b):
    return _titled(b).filter(~text.other_feed_title(F.col("title"))).select("id")


@check("single_speaker_docs", """
SELECT doc_id, title FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' Remarks at a Town Hall' WHEN 1 THEN 'Remarks ' || source WHEN 2 THEN 'LETTER to ' || source
  WHEN 3 THEN 'The Address' ELSE 'Statement ' || lang END AS title FROM documents) WHERE title LIKE 'Remarks src%' OR title LIKE 'LETTER%' OR title LIKE 'Statement%'""")
def single_speaker_docs(b):
    doc = F.col("doc_id")
    title = (
        F.when(doc % 5 == 0, " Remarks at a Town Hall").when(doc % 5 == 1, F.concat(F.lit("Remarks "), "source"))
        .when(doc % 5 == 2, F.concat(F.lit("LETTER to "), "source")).when(doc % 5 == 3, "The Address")
        .otherwise(F.concat(F.lit("Statement "), "lang"))
    )
    rows = b.table("documents").select("doc_id", title.alias("title"))
    return rows.filter(text.single_speaker(F.col("title")))


@check("route_communications", with_entities("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'office_fact_sheet' WHEN 1 THEN 'office_remarks' WHEN 2 THEN 'office_briefing' ELSE 'office_statement' END AS category,
  CASE WHEN doc_id % 4 = 1 THEN 'statement' ELSE 'action' END AS destination, CASE WHEN doc_id % 4 = 1 THEN 0.85::DOUBLE END AS confidence, length(substr(text, 1, 8000)) AS chars
FROM documents WHERE doc_id % 11 <> 0 AND length(substr(text, 1, 8000)) >= 80 AND NOT (doc_id % 4 = 1 AND doc_id % 3 = 0)"""))
def route_communications(b):
    doc = F.col("doc_id")
    path = F.array(*[F.lit(p) for p in ("fact-sheets", "remarks", "briefings", "articles")])
    rows = b.table("documents").select(
        "doc_id",
        F.concat_ws("/", F.lit("https://office.example"), F.element_at(path, (doc % 4 + 1).cast("int")), doc).alias("url"),
        F.when(doc % 3 == 0, "Remarks by the Deputy").otherwise("Remarks by President Doe").alias("title"),
        F.when(doc % 11 != 0, F.lit("2025-01-01").cast("date")).alias("date"),
        F.col("text").alias("body"),
    )
    routed = documents.route_communications(rows, publisher="office", subject=r"president\s+doe")
    return routed.select("doc_id", "category", "destination", "confidence", F.length("summary").alias("chars"))


@check("length_gate", """
SELECT doc_id, form, length(substr(venue, 1, 200)) AS venue_chars, md5(substr(text, 1, CASE form WHEN 'action' THEN 8000 ELSE 60000 END)) AS text_key
FROM (SELECT doc_id, text, text AS venue, CASE WHEN length(text) >= 200 THEN 'remarks' WHEN length(text) >= 120 THEN 'statement' WHEN length(text) >= 80 THEN 'action' END AS form FROM documents)
WHERE form IS NOT NULL""")
def length_gate(b):
    rows = documents.length_gate(b.table("documents").select("doc_id", "text", F.col("text").alias("venue")))
    return rows.select("doc_id", "form", F.length("venue").alias("venue_chars"), F.md5("text").alias("text_key"))


@check("select_media", """
SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL WHEN conv_id % 3 = 0 THEN 'tier-A channel' WHEN turn % 5 IN (0, 1) THEN 'title: subject + speech term'
  WHEN turn % 5 = 2 AND length(text) >= 180 THEN 'duration ≥ 3min + subject in title' END AS rule
FROM (SELECT DISTINCT conv_id, turn, first_value(text) OVER (PARTITION BY conv_id, turn ORDER BY text) AS text FROM conversations)""")
def select_media(b):
    turn = F.col("turn") % 5
    title = (
        F.when(turn == 0, "President Doe delivers a speech").when(turn == 1, "FULL: Doe remarks")
        .when(turn == 2, "Doe on the lawn").when(turn == 3, "Weather").otherwise("Doe speech: analysis")
    )
    rows = b.table("conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    tier = F.when(F.col("conv_id") % 3 == 0, "A").otherwise("B")
    return rows.select("conv_id", "turn", text.selection_rule(title, tier, F.length("text"), "doe").alias("rule"))


@check("parse_dates", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS long_date, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS dotted,
  strftime(ts, '%Y-%m-%d') AS iso_or_us, strftime(ts, '%Y-%m-01') AS from_path FROM events""")
def parse_dates(b):
    ts, key = F.col("ts"), F.col("event_id")
    dotted = F.when(key % 4 == 0, F.lit("report-13.45.24.pdf")).when(
        key % 2 == 0, F.concat(F.lit("report-"), F.date_format(ts, "M.d.yy"), F.lit("-1.pdf"))
    ).otherwise(F.concat(F.lit("r "), F.date_format(ts, "MM.dd.yyyy"), F.lit(".pdf")))
    either = F.when(key % 2 == 0, F.concat(F.lit("on "), F.date_format(ts, "M/d/yyyy"), F.lit(", 99"))).otherwise(
        F.concat(F.lit("1/2/1999 and "), F.date_format(ts, "yyyy-MM-dd"))
    )
    return b.table("events").select(
        "event_id",
        dates.long_date(F.concat(F.lit("Published "), F.upper(F.date_format(ts, "MMMM d, yyyy")), F.lit(" at noon"))).alias("long_date"),
        dates.dotted_date(dotted).alias("dotted"),
        dates.iso_or_us_date(either).alias("iso_or_us"),
        dates.path_month(F.concat(F.lit("https://x.example/news/"), F.date_format(ts, "yyyy/MM"), F.lit("/slug/"))).alias("from_path"),
    )


@check("parse_duration", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN s = 0 THEN NULL ELSE s END AS seconds
FROM (SELECT event_id, (event_id % 3) * 3600 + (event_id % 60) * 60 + user_id % 60 AS s FROM events)""")
def parse_duration(b):
    key = F.col("event_id")
    iso = F.concat(
        F.lit("PT"), F.when(key % 3 > 0, F.concat(key % 3, F.lit("H"))).otherwise(""),
        key % 60, F.lit("M"), F.col("user_id") % 60, F.lit("S"),
    )
    value = F.when(key % 7 == 0, F.lit("P1D")).otherwise(iso)
    return b.table("events").select("event_id", dates.iso_duration_seconds(value).alias("seconds"))


@check("redact_urls", """
SELECT page_id, url || CASE WHEN strpos(url, '?') > 0 THEN '&' ELSE '?' END || 'api_key=***&x=1&Token=*** end' AS line FROM pages""")
def redact_urls(b):
    url = F.col("url")
    joint = F.when(F.instr(url, F.lit("?")) > 0, "&").otherwise("?")
    line = F.concat(url, joint, F.lit("api_key=k"), "page_id", F.lit("&x=1&Token=abc"), F.md5(url), F.lit(" end"))
    return b.table("pages").select("page_id", text.redact_secrets(line).alias("line"))


@check("content_key", "SELECT doc_id, sha256('docs:' || doc_id) AS by_id, sha256('text:' || text) AS by_text FROM documents")
def content_key(b):
    return b.table("documents").select(
        "doc_id", text.content_key("docs", F.col("doc_id")).alias("by_id"), text.content_key("text", F.col("text")).alias("by_text")
    )
