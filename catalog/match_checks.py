"""Prices, names, mentions, reconciliation and superseding."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import fixed, names, text
from sightline.operators import aggregates as A
from sightline.operators import reconcile as R
from sightline.operators import resolve, series, spans, superseding

from .bindings import with_entities
from .registry import check

# --- prices -------------------------------------------------------------------------------

ASOF_SQL = """
asof_row AS (
  SELECT d.id, d.ticker, d.date, p.date AS price_date, p.close AS price_at
  FROM deal d ASOF LEFT JOIN price p ON p.ticker = d.ticker AND p.date <= d.date),
latest AS (SELECT ticker, arg_max(close, date) AS stored FROM price GROUP BY ticker),
quote AS (SELECT 'U' || user_id AS ticker, round(max(value), 2) AS quote FROM events
  WHERE event_type = 'click' AND user_id % 3 = 0 GROUP BY ALL),
now AS (SELECT ticker, coalesce(quote, stored) AS price_now FROM latest LEFT JOIN quote USING (ticker)),
stamped AS (
  SELECT a.*, price_now, CASE WHEN price_at > 0 THEN floor((price_now - price_at) / price_at * 1000 + 0.5) / 10 END AS gain_loss_pct
  FROM asof_row a JOIN now USING (ticker) WHERE price_at IS NOT NULL AND price_now <> 0)
"""


def _quotes(b):
    clicks = b.table("events").filter((F.col("event_type") == "click") & (F.col("user_id") % 3 == 0))
    return clicks.groupBy(F.concat(F.lit("U"), "user_id").alias("ticker")).agg(
        F.round(F.max("value"), 2).alias("quote")
    )


@check("asof_price", with_entities("WITH" + ASOF_SQL + """
SELECT id, ticker, strftime(date, '%Y-%m-%d') AS date, strftime(price_date, '%Y-%m-%d') AS price_date, price_at FROM asof_row"""))
def asof_price(b):
    return series.asof_price(b.deal, b.price).select("id", "ticker", "date", "price_date", "price_at")


@check("latest_price", with_entities("WITH" + ASOF_SQL + "SELECT ticker, price_now FROM now"))
def latest_price(b):
    return series.latest_price(b.price, _quotes(b))


@check("nearest_price", with_entities("""
SELECT id, ticker, strftime(snapped, '%Y-%m-%d') AS snapped_date FROM (
  SELECT d.id, d.ticker, p.date AS snapped, row_number() OVER (PARTITION BY d.id ORDER BY abs(date_diff('day', d.date, p.date)), p.date) AS n
  FROM deal d JOIN price p ON p.ticker = d.ticker) WHERE n = 1"""))
def nearest_price(b):
    return series.nearest_price(b.deal, b.price).select("id", "ticker", "snapped_date")


STAMP_COLUMNS = ["id", "ticker", "price_at", "price_now", "gain_loss_pct"]


@check("stamp_prices", with_entities("WITH" + ASOF_SQL + "SELECT " + ", ".join(STAMP_COLUMNS) + " FROM stamped"))
def stamp_prices(b):
    return series.stamp_prices(b.deal, b.price, _quotes(b)).select(*STAMP_COLUMNS)


@check("gain_loss", with_entities("WITH" + ASOF_SQL + """
SELECT ticker, count(*) AS n, max(gain_loss_pct) AS best, min(gain_loss_pct) AS worst FROM stamped GROUP BY ticker"""))
def gain_loss(b):
    stamped = series.stamp_prices(b.deal, b.price, _quotes(b))
    return stamped.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("gain_loss_pct").alias("best"),
        F.min("gain_loss_pct").alias("worst"),
    )


@check("gain_loss_leaders", with_entities("WITH" + ASOF_SQL + """
SELECT * FROM (SELECT 'gain' AS side, id, ticker, gain_loss_pct FROM stamped WHERE gain_loss_pct > 0 ORDER BY gain_loss_pct DESC, id LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'loss' AS side, id, ticker, gain_loss_pct FROM stamped WHERE gain_loss_pct < 0 ORDER BY gain_loss_pct, id LIMIT 3)"""))
def gain_loss_leaders(b):
    stamped = series.stamp_prices(b.deal, b.price, _quotes(b))
    return A.gain_loss_leaders(stamped).select("side", "id", "ticker", "gain_loss_pct")


@check("explode_price_series", """
SELECT 'U' || user_id AS ticker, strftime(ts, '%Y-%m-%d') AS date, floor(max(value) * 100 + 0.5) / 100 AS close
FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY ALL HAVING max(value) > 0""")
def explode_price_series(b):
    daily = b.table("events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.max("value").alias("v")
    )
    entry = F.struct("day", F.struct(F.col("v").cast("decimal(18,7)").cast("string").alias("4. close")).alias("e"))
    noise = F.create_map(F.lit("Note"), F.struct(F.lit("n/a").alias("4. close")))
    payload = daily.groupBy("user_id").agg(F.collect_list(entry).alias("rows")).select(
        F.concat(F.lit("U"), "user_id").alias("ticker"),
        F.to_json(F.map_concat(F.map_from_entries("rows"), noise)).alias("json"),
    )
    return series.explode_price_series(payload, "2024-01-05")


# --- names --------------------------------------------------------------------------------

TITLE_SQL = """
title AS (
  SELECT min(p_partkey) AS position, 'P' || min(p_partkey) AS ticker, p_name AS title
  FROM part GROUP BY p_name),
norm AS (
  SELECT *, trim(regexp_replace(regexp_replace(upper(title), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS raw FROM title),
mapped AS (
  SELECT position, ticker, title, array_to_string([w FOR w IN string_split(raw, ' ') IF NOT regexp_full_match(w, '{noise}')], ' ') AS name_key FROM norm),
printed AS (
  SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' 4% BOND DUE 2030'
    WHEN p_partkey % 2 = 0 THEN p_name || ' CORP' WHEN p_partkey % 5 = 0 THEN 'Unknown ' || p_type
    ELSE p_name || ' ' || p_type || ' COM' END AS description FROM part),
dkey AS (
  SELECT DISTINCT description, regexp_matches(description, '(?i)\\b(DUE|REV|B/E|OID|CTF|RFDG|RFUNDING|MUN|MTN|NOTE|BOND|GO\\b|G/O|SER\\b|@\\d)') AS non_equity,
    array_to_string([w FOR w IN string_split(trim(regexp_replace(regexp_replace(upper(description), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')
      IF NOT regexp_full_match(w, '{noise}')], ' ') AS name_key
  FROM printed),
exact AS (SELECT d.description, m.ticker, m.title, m.position FROM dkey d JOIN mapped m USING (name_key) WHERE NOT d.non_equity AND length(name_key) >= 3),
prefixed AS (
  SELECT description, ticker, title FROM (
    SELECT d.description, m.ticker, m.title, row_number() OVER (PARTITION BY d.description ORDER BY m.position) AS n
    FROM dkey d JOIN mapped m ON starts_with(d.name_key, m.name_key || ' ')
    WHERE NOT d.non_equity AND length(d.name_key) >= 3 AND (contains(m.name_key, ' ') OR length(m.name_key) >= 9)
      AND d.description NOT IN (SELECT description FROM exact)) WHERE n = 1),
outcome AS (
  SELECT d.description, coalesce(e.ticker, p.ticker) AS ticker, coalesce(e.title, p.title) AS title,
    CASE WHEN d.non_equity THEN 'non_equity' WHEN e.ticker IS NOT NULL THEN 'exact' WHEN p.ticker IS NOT NULL THEN 'prefix' ELSE 'unresolved' END AS tier
  FROM dkey d LEFT JOIN exact e USING (description) LEFT JOIN prefixed p USING (description))
""".replace("{noise}", fixed.NAME_NOISE)


def _titles(b):
    return b.table("part").groupBy(F.col("p_name").alias("title")).agg(
        F.min("p_partkey").alias("position")
    ).withColumn("ticker", F.concat(F.lit("P"), "position"))


def _printed(b):
    part, name = F.col("p_partkey"), F.col("p_name")
    description = (
        F.when(part % 7 == 0, F.concat(name, F.lit(" 4% BOND DUE 2030")))
        .when(part % 2 == 0, F.concat(name, F.lit(" CORP")))
        .when(part % 5 == 0, F.concat(F.lit("Unknown "), "p_type"))
        .otherwise(F.concat_ws(" ", name, "p_type", F.lit("COM")))
    )
    return b.table("part").select(part.alias("id"), description.alias("description"))


@check("split_non_equity", with_entities("WITH" + TITLE_SQL + """
SELECT non_equity, count(*) AS n FROM printed JOIN dkey USING (description) GROUP BY ALL"""))
def split_non_equity(b):
    flagged = _printed(b).withColumn("non_equity", names.is_non_equity(F.col("description")))
    return flagged.groupBy("non_equity").agg(F.count(F.lit(1)).alias("n"))


@check("resolve_exact", with_entities("WITH" + TITLE_SQL + "SELECT description, ticker, title FROM exact"))
def resolve_exact(b):
    keys = resolve.description_keys(_printed(b)).filter(~F.col("non_equity") & (F.length("name_key") >= 3))
    return resolve.resolve_exact(keys, resolve.name_map(_titles(b))).select("description", "ticker", "title")


@check("resolve_prefix", with_entities("WITH" + TITLE_SQL + "SELECT description, ticker, title FROM prefixed"))
def resolve_prefix(b):
    found = resolve.resolve_descriptions(_printed(b), _titles(b))
    return found.filter(F.col("tier") == "prefix").select("description", "ticker", "title")


@check("enrich_transactions", with_entities("WITH" + TITLE_SQL + """
SELECT p.p_partkey AS id, o.tier, o.ticker, CASE WHEN o.ticker IS NOT NULL THEN coalesce(CAST(k.id AS VARCHAR), sha256(o.ticker)) END AS company_id
FROM printed p JOIN outcome o USING (description) LEFT JOIN (SELECT id, 'P' || id AS ticker FROM company) k USING (ticker)"""))
def enrich_transactions(b):
    resolved = resolve.resolve_companies(_printed(b), _titles(b))
    known = b.company.select("id", F.concat(F.lit("P"), "id").alias("ticker"))
    stamped = resolve.stamp_companies(resolved, known)
    return stamped.select("id", "tier", "ticker", F.col("new_company_id").alias("company_id"))


@check("normalize_name", with_entities("WITH" + TITLE_SQL + "SELECT description, name_key FROM dkey"))
def normalize_name(b):
    return resolve.description_keys(_printed(b)).select("description", "name_key")


GENERIC_SQL = "(" + ", ".join(f"'{w}'" for w in fixed.GENERIC_NAME_WORDS) + ")"
WEAK_SQL = "(" + ", ".join(f"'{w}'" for w in fixed.WEAK_SOLO_TOKENS) + ")"
KEY_SQL = f"""
SELECT name, CASE WHEN len(w) = 1 AND length(w[1]) >= 5 AND w[1] NOT IN {WEAK_SQL} THEN w[1]
  WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END AS match_key
FROM (SELECT name, [x FOR x IN string_split_regex(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), '\\s+')
  IF length(x) >= 4 AND x NOT IN {GENERIC_SQL}] AS w
  FROM (SELECT DISTINCT p_name || ' ' || lower(p_type) || ' inc' AS name FROM part
    UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ' holdings' FROM part
    UNION SELECT s_name FROM supplier UNION SELECT n_name || ' energy corp' FROM nation))"""


@check("company_match_key", KEY_SQL)
def company_match_key(b):
    part = b.table("part")
    listed = (
        part.select(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" inc")).alias("name"))
        .union(part.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" holdings"))))
        .union(b.table("supplier").select("s_name"))
        .union(b.table("nation").select(F.concat("n_name", F.lit(" energy corp"))))
        .distinct()
    )
    return listed.select("name", names.match_key(F.col("name")).alias("match_key"))


@check("code_to_sector", """
SELECT code, count(*) AS n, CASE WHEN code BETWEEN 100 AND 999 THEN 'Agriculture & Natural Resources'
  WHEN code BETWEEN 1000 AND 1499 THEN 'Mining & Extraction' WHEN code BETWEEN 1500 AND 1799 THEN 'Construction'
  WHEN code BETWEEN 2000 AND 3999 THEN 'Manufacturing' WHEN code BETWEEN 4000 AND 4999 THEN 'Transportation & Utilities'
  WHEN code BETWEEN 5000 AND 5199 THEN 'Wholesale Trade' WHEN code BETWEEN 5200 AND 5999 THEN 'Retail Trade'
  WHEN code BETWEEN 6000 AND 6799 THEN 'Finance, Insurance & Real Estate' WHEN code BETWEEN 7000 AND 8999 THEN 'Services'
  WHEN code >= 9100 THEN 'Public Administration' ELSE 'Other' END AS sector
FROM (SELECT CAST(o_orderkey * 37 % 9500 AS BIGINT) AS code FROM orders) GROUP BY ALL""")
def code_to_sector(b):
    codes = b.table("orders").select((F.col("o_orderkey") * 37 % 9500).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "sector", names.code_to_sector(F.col("code"))
    )


# Industries for the topic rules: every nation gets one of these descriptions.
INDUSTRIES = [
    "Semiconductors & Related Devices", "Air Transportation, Scheduled", "Pharmaceutical Preparations",
    "Guided Missiles & Space Vehicles", "National Commercial Banks", "Crude Petroleum & Natural Gas",
    "Motor Vehicles & Car Bodies", "Steel Works, Blast Furnaces", "Electric Services",
    "Aircraft Engines", "Services-Prepackaged Software", "Riverbanks Leisure",
]
INDUSTRY_SQL = "CASE n_nationkey % 12 " + " ".join(
    f"WHEN {i} THEN '{name}'" for i, name in enumerate(INDUSTRIES)
) + " END"
TOPIC_SQL = ", ".join(
    f"CASE WHEN regexp_matches(hay, '(?i){industry}') THEN '{topic}' END" for topic, _, _, industry in fixed.TOPICS
)


@check("company_topics", f"""
SELECT id, array_to_string([x FOR x IN [{TOPIC_SQL}] IF x IS NOT NULL], '|') AS topics
FROM (SELECT s_suppkey AS id, {INDUSTRY_SQL} || ' ' || coalesce(r_name, '') AS hay
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def company_topics(b):
    table = F.array(*[F.lit(x) for x in INDUSTRIES])
    industry = F.try_element_at(table, (F.col("n_nationkey") % 12 + 1).cast("int"))
    return b.region_of_supplier.select(
        F.col("s_suppkey").alias("id"), names.company_topics(industry, F.col("r_name")).alias("topics")
    )


@check("recipient_match", """
SELECT c.id AS company_id, a.award_id FROM (
  SELECT s_suppkey AS id, [w FOR w IN string_split_regex(regexp_replace(upper(name), '[^A-Z0-9 ]', ' ', 'g'), '\\s+')
    IF length(w) >= 4 AND w NOT IN ('CORP','CORPORATION','COMPANY','HOLDINGS','GROUP','TRUST','LIMITED')][1:2] AS tokens
  FROM (SELECT s_suppkey, p_name || ' ' || p_type || ' Holdings Corp' AS name FROM supplier JOIN part ON p_partkey = s_suppkey)) c
JOIN (SELECT p_partkey AS award_id, 'The ' || p_name || p_type || ' Group of ' || p_type || 's' AS recipient FROM part) a
  ON len(c.tokens) > 0 AND contains(upper(a.recipient), c.tokens[1]) AND (len(c.tokens) < 2 OR contains(upper(a.recipient), c.tokens[2]))""")
def recipient_match(b):
    firms, awards = _firms(b), _award_recipients(b)
    return resolve.recipient_matches(firms, awards).select("company_id", "award_id")


def _firms(b):
    return b.table("supplier").join(b.table("part"), F.col("p_partkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", F.lit("Holdings Corp")).alias("name")
    )


def _award_recipients(b):
    return b.table("part").select(
        F.col("p_partkey").alias("award_id"),
        F.concat(F.lit("The "), "p_name", "p_type", F.lit(" Group of "), "p_type", F.lit("s")).alias("recipient"),
    )


# --- mentions -----------------------------------------------------------------------------

GAZ_SQL = """
gaz AS (
  SELECT DISTINCT item_id AS company_id, lower(ws[i]) AS w1, lower(ws[i + 1]) AS w2
  FROM (SELECT item_id, string_split_regex(text, '\\s+') AS ws FROM benchmark), unnest(range(1, len(ws))) AS u(i)
  WHERE regexp_full_match(ws[i], '[A-Za-z]{4,}') AND regexp_full_match(ws[i + 1], '[A-Za-z]{4,}')),
seen AS (
  SELECT DISTINCT doc_id, ws[i] AS w1, ws[i + 1] AS w2
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM documents), unnest(range(1, len(ws))) AS u(i)),
pattern AS (
  SELECT doc_id, company_id, '(?i)\\b' || w1 || '\\s+' || w2 || '\\b' AS p FROM seen JOIN gaz USING (w1, w2)),
hit AS (
  SELECT doc_id, company_id, text, regexp_extract_all(text, p) AS found, string_split_regex(text, p) AS gaps
  FROM documents JOIN pattern USING (doc_id) WHERE regexp_matches(text, p)),
span AS (
  SELECT doc_id, company_id, text, i, found[i] AS match,
    CAST(list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(f) FOR f IN found[1:i-1]]), 0) AS BIGINT) AS char_start
  FROM hit, unnest(range(1, len(found) + 1)) AS u(i)),
context AS (
  SELECT doc_id, company_id, char_start, char_start + length(match) AS char_end,
    regexp_replace(substr(text, CAST(greatest(char_start - 80, 0) AS BIGINT) + 1,
      CAST(char_start + length(match) + 80 - greatest(char_start - 80, 0) AS BIGINT)), '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g') AS quote
  FROM span)
"""


def _gazetteer(b):
    """Every pair of neighbouring words of four letters or more of the benchmark texts."""
    pairs = F.filter(text.adjacent_pairs(F.col("words")), lambda p: p.rlike("^[a-z]{4,} [a-z]{4,}$"))
    return b.table("benchmark").select("item_id", F.split(F.lower("text"), r"\s+").alias("words")).select(
        F.col("item_id").alias("company_id"),
        F.concat(F.lit("T"), "item_id").alias("ticker"),
        F.explode_outer(F.array_distinct(pairs)).alias("name_key"),
    )


def _texts(b):
    return b.table("documents").select("doc_id", "text")


@check("mentions_company", with_entities("WITH" + GAZ_SQL + """
SELECT doc_id, company_id, char_start, char_end, quote, 0.6::DOUBLE AS confidence, 'gazetteer' AS method FROM context"""))
def mentions_company(b):
    return spans.find_company_spans(_texts(b), _gazetteer(b)).select(
        "doc_id", "company_id", "char_start", "char_end", "quote", "confidence", "method"
    )


@check("redetect_mentions", with_entities("WITH" + GAZ_SQL + """
SELECT doc_id, company_id, method, count(*) AS n FROM (
  SELECT doc_id, company_id, 'gazetteer' AS method FROM context WHERE doc_id % 3 <> 0
  UNION ALL SELECT doc_id, doc_id % 7, 'llm' FROM documents UNION ALL SELECT doc_id, -1, 'gazetteer' FROM documents WHERE doc_id % 3 = 0)
GROUP BY ALL"""))
def redetect_mentions(b):
    """Two thirds of the texts are looked through again; stored rows are one of a model and one of
    an earlier gazetteer for each text."""
    docs, doc = b.table("documents"), F.col("doc_id")
    stored = docs.select("doc_id", (doc % 7).alias("company_id"), F.lit("llm").alias("method")).unionByName(
        docs.select("doc_id", F.lit(-1).cast("bigint").alias("company_id"), F.lit("gazetteer").alias("method"))
    )
    again = _texts(b).filter(doc % 3 != 0)
    found = spans.find_company_spans(again, _gazetteer(b))
    return spans.redetect(stored, again, found).groupBy("doc_id", "company_id", "method").agg(F.count("*").alias("n"))


# Topic rules over the given prose, which is made of invented words.
PROSE_TOPICS = [
    ("nation", r"\bnation\w*\b"), ("the_of", r"\bthe\s+of\b"), ("und", r"\bund\s+d(?:er|ie)\b"),
    ("avec", r"\bavec\b|\bdans\b"),
]
PROSE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, text, '{name}' AS topic, '(?i)({pattern})' AS p FROM documents" for name, pattern in PROSE_TOPICS
)


@check("mentions_topic", f"""
SELECT doc_id, topic, char_start, char_start + length(match) AS char_end,
  regexp_replace(substr(text, greatest(char_start - 80, 0) + 1, char_start + length(match) + 80 - greatest(char_start - 80, 0)),
    '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') AS quote, 0.5::DOUBLE AS confidence, 'gazetteer' AS method
FROM (SELECT doc_id, text, topic, regexp_extract(text, p, 1) AS match, length(string_split_regex(text, p)[1]) AS char_start
  FROM ({PROSE_SQL}) WHERE regexp_matches(text, p))""")
def mentions_topic(b):
    return spans.find_topic_spans(_texts(b), PROSE_TOPICS).select(
        "doc_id", "topic", "char_start", "char_end", "quote", "confidence", "method"
    )


@check("mention_spans", with_entities("WITH" + GAZ_SQL + """
SELECT company_id, count(*) AS spans, count(DISTINCT doc_id) AS docs, CAST(min(char_start) AS BIGINT) AS first_start,
  CAST(sum(char_end - char_start) AS BIGINT) AS covered FROM context GROUP BY company_id"""))
def mention_spans(b):
    found = spans.find_company_spans(_texts(b), _gazetteer(b))
    return found.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_distinct("doc_id").alias("docs"),
        F.min("char_start").alias("first_start"),
        F.sum(F.col("char_end") - F.col("char_start")).alias("covered"),
    )


PROSE_LINK_SQL = " UNION ALL ".join(
    f"SELECT doc_id AS action_id, NULL::BIGINT AS company_id, '{name}' AS sector, 'sector' AS link_method, "
    f"0.5::DOUBLE AS confidence FROM documents WHERE regexp_matches(venue || chr(10) || text, '(?i){pattern}')".replace(
        "FROM documents", "FROM (SELECT *, source || ' ' || lang AS venue FROM documents)")
    for name, pattern in PROSE_TOPICS
)


@check("link_actions", with_entities("WITH" + GAZ_SQL + f"""
SELECT DISTINCT doc_id AS action_id, company_id, NULL::VARCHAR AS sector, 'named' AS link_method, 0.6::DOUBLE AS confidence
FROM hit WHERE doc_id % 3 <> 0 OR company_id % 2 <> 0 UNION ALL {PROSE_LINK_SQL}"""))
def link_actions(b):
    action = b.table("documents").select(
        F.col("doc_id").alias("action_id"), F.concat_ws(" ", "source", "lang").alias("title"),
        F.col("text").alias("summary"),
    )
    # authoritative links: every third action with every second company that it names
    named = spans.company_hits(_texts(b), _gazetteer(b)).select(F.col("doc_id").alias("action_id"), "company_id")
    preserved = named.filter((F.col("action_id") % 3 == 0) & (F.col("company_id") % 2 == 0)).distinct()
    return spans.link_actions(action, _gazetteer(b), preserved, PROSE_TOPICS)


QUOTE_SQL = """
proposal AS (
  SELECT doc_id AS statement_id, CASE WHEN doc_id % 4 = 0 THEN 'not in the text ' || doc_id
    WHEN doc_id % 4 = 1 THEN '  ' || substr(text, 11, 25) || ' ' ELSE substr(text, CAST(floor(length(text) / 2.0) AS BIGINT), 12) END AS quote, text
  FROM documents),
located AS (
  SELECT *, regexp_replace(quote, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g') AS q FROM proposal)
"""


def _proposals(b):
    doc, body = F.col("doc_id"), F.col("text")
    quote = (
        F.when(doc % 4 == 0, F.concat(F.lit("not in the text "), doc))
        .when(doc % 4 == 1, F.concat(F.lit("  "), F.substring(body, 11, 25), F.lit(" ")))
        .otherwise(F.substring(body, F.floor(F.length(body) / 2).cast("int"), F.lit(12)))
    )
    return b.table("documents").select(doc.alias("statement_id"), quote.alias("quote"), body.alias("full_text"))


@check("verify_quotes", with_entities("WITH" + QUOTE_SQL + """
SELECT statement_id, CASE WHEN ok THEN instr(text, q) - 1 END AS char_start, CASE WHEN ok THEN instr(text, q) - 1 + length(q) END AS char_end
FROM (SELECT *, length(q) >= 3 AND instr(text, q) > 0 AS ok FROM located)"""))
def verify_quotes(b):
    rows = _proposals(b).withColumn("span", spans.verify_quote(F.col("full_text"), F.col("quote")))
    return rows.select("statement_id", "span.char_start", "span.char_end")


LABEL_SQL = """
label AS (
  SELECT l.statement_id, (l.statement_id * 3 + k) % 40 AS seq, 's' || ((l.statement_id + k * 7) % (SELECT count(*) + 5 FROM supplier)) AS ticker, l.quote, l.text, l.q,
    CASE (l.statement_id + k) % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'mixed' ELSE 'neutral' END AS sentiment,
    CASE (l.statement_id + k) % 3 WHEN 0 THEN 'praise' WHEN 1 THEN 'shrug' ELSE 'policy' END AS stance,
    (k - 4)::DOUBLE / 15 AS confidence, k
  FROM located l, range(0, 26) r(k))
"""


def _labels(b):
    rows = _proposals(b).drop("full_text").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(25))))
    doc, k = F.col("statement_id"), F.col("k")
    companies = b.table("supplier").agg(F.count(F.lit(1))).scalar()
    return rows.select(
        doc, k.alias("seq"), "quote",
        F.concat(F.lit("s"), (doc + k * 7) % (companies + 5)).alias("ticker"),
        F.when((doc + k) % 4 == 0, "positive").when((doc + k) % 4 == 1, "negative")
        .when((doc + k) % 4 == 2, "mixed").otherwise("neutral").alias("sentiment"),
        F.when((doc + k) % 3 == 0, "praise").when((doc + k) % 3 == 1, "shrug").otherwise("policy").alias("stance"),
        ((k - 4) / 15).alias("confidence"),
    )


@check("clean_mention_labels", with_entities("WITH" + QUOTE_SQL + "," + LABEL_SQL + """
SELECT statement_id, k AS seq, CASE WHEN sentiment IN ('positive', 'negative', 'neutral') THEN sentiment END AS sentiment,
  CASE WHEN stance IN ('praise','attack','policy','tariff','contract','regulation','endorsement','other') THEN stance END AS stance,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, confidence)) AS confidence FROM label"""))
def clean_mention_labels(b):
    return spans.clean_labels(_labels(b)).select("statement_id", "seq", "sentiment", "stance", "confidence")


@check("apply_labels", with_entities("WITH" + QUOTE_SQL + "," + LABEL_SQL + """,
valid AS (
  SELECT l.statement_id, c.id AS company_id, l.k, instr(l.text, l.q) - 1 AS char_start, instr(l.text, l.q) - 1 + length(l.q) AS char_end,
    CASE WHEN sentiment IN ('positive', 'negative', 'neutral') THEN sentiment END AS sentiment,
    CASE WHEN stance IN ('praise','attack','policy','tariff','contract','regulation','endorsement','other') THEN stance END AS stance,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, l.confidence)) AS confidence
  FROM label l JOIN company c ON upper(c.ticker) = upper(l.ticker)
  WHERE l.k < 20 AND length(l.q) >= 3 AND instr(l.text, l.q) > 0),
last_label AS (SELECT DISTINCT ON (statement_id, company_id) * FROM valid ORDER BY statement_id, company_id, k DESC),
first_label AS (SELECT DISTINCT ON (statement_id, company_id) * FROM valid ORDER BY statement_id, company_id, k)
SELECT m.statement_id, m.company_id, 0::BIGINT AS char_start, 0::BIGINT AS char_end, 0.6::DOUBLE AS confidence, 'gazetteer' AS method,
  CASE WHEN v.k IS NULL THEN m.sentiment ELSE v.sentiment END AS sentiment, CASE WHEN v.k IS NOT NULL THEN v.stance END AS stance
FROM mention m LEFT JOIN last_label v USING (statement_id, company_id) WHERE m.company_id IS NOT NULL
UNION ALL
SELECT f.statement_id, f.company_id, f.char_start, f.char_end, f.confidence, 'llm', l.sentiment, l.stance
FROM first_label f JOIN last_label l USING (statement_id, company_id)
WHERE (f.statement_id, f.company_id) NOT IN (SELECT (statement_id, company_id) FROM mention WHERE company_id IS NOT NULL)"""))
def apply_labels(b):
    mention = b.mention.filter(F.col("company_id").isNotNull()).select(
        "statement_id", "company_id", "sentiment", F.lit(None).cast("string").alias("stance"),
        F.lit(0).alias("char_start"), F.lit(0).alias("char_end"), "confidence", F.lit("gazetteer").alias("method"),
    )
    return spans.apply_labels(mention, _labels(b), b.statement, b.company)


# --- reconciliation and superseding ---------------------------------------------------------

RECORD_SQL = """
ours AS (
  SELECT t.*, c.ticker FROM described t JOIN filing f ON f.id = t.filing_id LEFT JOIN company c ON c.id = t.company_id
  WHERE f.status IN ('parsed', 'published')),
record AS (
  SELECT id AS record_id, CASE WHEN id % 3 = 0 THEN 'beta' ELSE 'alpha' END AS source, date + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS date,
    CASE WHEN id % 4 <> 0 THEN lower(ticker) END AS ticker,
    CASE WHEN id % 6 = 0 THEN split_part(description, ' ', 1) || ' ' || split_part(description, ' ', 2) || ', Inc.' ELSE description || ' class' END AS description,
    CASE WHEN id % 11 <> 0 THEN amount_min * CASE WHEN id % 5 = 0 THEN 3 ELSE 1 END END AS amount_min,
    CASE WHEN id % 11 <> 0 AND id % 13 <> 0 THEN amount_max * CASE WHEN id % 5 = 0 THEN 3 ELSE 1 END END AS amount_max
  FROM ours),
clean_ours AS (SELECT id, date, upper(ticker) AS ticker, amount_min, coalesce(amount_max, 9e18) AS amount_max, {d} AS d FROM ours),
clean_record AS (SELECT *, {d} AS d FROM record),
meeting AS (
  SELECT r.record_id, r.amount_min, r.amount_max, t.id, t.amount_min AS our_min, t.amount_max AS our_max
  FROM clean_record r JOIN clean_ours t ON t.date = r.date AND t.ticker = upper(r.ticker)
  UNION ALL
  SELECT r.record_id, r.amount_min, r.amount_max, t.id, t.amount_min, t.amount_max
  FROM clean_record r JOIN clean_ours t ON t.date = r.date AND left(t.d, 4) = left(r.d, 4)
  WHERE length(r.d) >= 4 AND length(t.d) >= 4 AND (starts_with(r.d, t.d) OR starts_with(t.d, r.d))),
match0 AS (
  SELECT record_id, min(id) AS trade_id FROM meeting
  WHERE amount_min IS NULL OR (amount_min <= our_max AND our_min <= coalesce(amount_max, 9e18))
  GROUP BY record_id),
matches AS (SELECT r.record_id, r.source, m.trade_id FROM record r LEFT JOIN match0 m USING (record_id)),
prior AS (SELECT id AS trade_id, ['alpha'] AS prior FROM ours WHERE id % 2 = 0),
sources AS (
  SELECT trade_id, list_sort(list_distinct(list_concat(coalesce(any_value(prior), []), list(source)))) AS sources, coalesce(len(any_value(prior)), 0) AS before
  FROM matches LEFT JOIN prior USING (trade_id) WHERE trade_id IS NOT NULL GROUP BY trade_id)
""".replace("{d}", """array_to_string([w FOR w IN string_split(trim(regexp_replace(regexp_replace(upper(description), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')
    IF NOT regexp_full_match(w, '{noise}')], ' ')""".replace("{noise}", fixed.DESCRIPTION_NOISE))


def _records(b):
    rows = b.ours.join(b.listed.select(F.col("id").alias("company_id"), "ticker"), "company_id", "left")
    key, desc = F.col("id"), F.col("description")
    factor = F.when(key % 5 == 0, 3).otherwise(1)
    two = F.concat_ws(" ", F.split_part(desc, F.lit(" "), F.lit(1)), F.split_part(desc, F.lit(" "), F.lit(2)))
    return rows.select(
        key.alias("record_id"),
        F.when(key % 3 == 0, "beta").otherwise("alpha").alias("source"),
        F.date_add("date", F.when(key % 7 == 0, 1).otherwise(0)).alias("date"),
        F.when(key % 4 != 0, F.lower("ticker")).alias("ticker"),
        F.when(key % 6 == 0, F.concat(two, F.lit(", Inc."))).otherwise(F.concat(desc, F.lit(" class"))).alias("description"),
        F.when(key % 11 != 0, F.col("amount_min") * factor).alias("amount_min"),
        F.when((key % 11 != 0) & (key % 13 != 0), F.col("amount_max") * factor).alias("amount_max"),
    )


def _matches(b):
    return R.match_records(b.ours, b.listed, _records(b))


def _prior(b):
    return b.ours.filter(F.col("id") % 2 == 0).select(
        F.col("id").alias("trade_id"), F.array(F.lit("alpha")).alias("prior")
    )


@check("reconcile_match", with_entities("WITH" + RECORD_SQL + "SELECT record_id, source, trade_id FROM matches"))
def reconcile_match(b):
    return _matches(b).select("record_id", "source", "trade_id")


@check("reconciled_sources", with_entities("WITH" + RECORD_SQL + """
SELECT trade_id, array_to_string(sources, '|') AS sources, len(sources) = before AS already_reconciled FROM sources"""))
def reconciled_sources(b):
    return R.reconciled_sources(_matches(b), _prior(b)).select("trade_id", "sources", "already_reconciled")


@check("reconcile", with_entities("WITH" + RECORD_SQL + """
SELECT (SELECT count(*) FROM matches) AS records, (SELECT count(*) FROM matches WHERE trade_id IS NULL) AS unmatched_records,
  (SELECT count(*) FROM sources) AS matched, (SELECT count(*) FROM sources WHERE len(sources) = before) AS already_reconciled"""))
def reconcile(b):
    # read by both parts of the summary
    matches = b.written(_matches(b).select("record_id", "source", "trade_id"), "matches")
    return R.reconcile_summary(matches, R.reconciled_sources(matches, _prior(b)))


@check("reconcile_conflicts", with_entities("WITH" + RECORD_SQL + """
SELECT r.record_id, r.source, strftime(r.date, '%Y-%m-%d') AS date, upper(r.ticker) AS ticker, r.amount_min AS rec_min, r.amount_max AS rec_max, min(t.id) AS trade_id
FROM record r JOIN ours t ON t.date = r.date AND t.ticker = upper(r.ticker) WHERE r.amount_min IS NOT NULL
GROUP BY ALL HAVING NOT bool_or(r.amount_min <= coalesce(t.amount_max, 9e18) AND t.amount_min <= coalesce(r.amount_max, 9e18))"""))
def reconcile_conflicts(b):
    return R.band_conflicts(b.ours, b.listed, _records(b))


SIMILAR_SQL = """
doc AS (
  SELECT doc_id AS id, DATE '2024-01-01' + CAST(length(split_part(text, ' ', 1)) AS INTEGER) AS day,
    source IN ('src0', 'src1', 'src2', 'src3', 'src4') AS official, text,
    [w FOR w IN string_split_regex(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\\s+') IF length(w) >= 3][1:120] AS w
  FROM documents),
gram AS (
  SELECT id, day, official, text, CASE WHEN len(w) >= 4 THEN list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) ELSE [] END AS g FROM doc),
pair AS (
  SELECT a.id AS official_id, b.id AS other_id, a.day,
    2.0::DOUBLE * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS similarity
  FROM gram a JOIN gram b ON a.day = b.day AND a.official AND NOT b.official WHERE len(a.g) > 0 AND len(b.g) > 0)
"""


def _copies(b, docs=None):
    source = F.col("source")
    return (docs or b.table("documents")).select(
        F.col("doc_id").alias("id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.length(F.split_part("text", F.lit(" "), F.lit(1)))).alias("day"),
        source.isin("src0", "src1", "src2", "src3", "src4").alias("official"),
        "text",
        F.lit("").alias("venue"),
    )


@check("supersede_same_day", with_entities("WITH" + SIMILAR_SQL + """
SELECT other_id AS id, strftime(day, '%Y-%m-%d') AS day, min(official_id) AS superseded_by FROM pair WHERE similarity >= 0.55 GROUP BY ALL"""))
def supersede_same_day(b):
    docs = _copies(b)
    return superseding.supersede_same_day(docs.filter("official"), docs.filter(~F.col("official")))


@check("text_similarity", with_entities("WITH" + SIMILAR_SQL + """
SELECT a.id, CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0.0::DOUBLE
  ELSE 2.0::DOUBLE * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) END AS similarity
FROM gram a JOIN gram b ON b.id = CASE WHEN a.id % 2 = 0 THEN a.id ELSE a.id - 1 END"""))
def text_similarity(b):
    docs = b.table("documents")
    other = docs.select(F.col("doc_id").alias("peer"), F.col("text").alias("peer_text"))
    peer = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") - 1)
    return docs.withColumn("peer", peer).join(other, "peer").select(
        F.col("doc_id").alias("id"), text.text_similarity(F.col("text"), F.col("peer_text")).alias("similarity")
    )
