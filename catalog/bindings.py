"""Entity frames over the given tables, and the same projections as SQL for the checks.

Nothing is filtered to make a check cheap: every table is bound whole. Remainders of ids
only give rows attribute values (a status, a source, a verdict), never select rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import bands
from sightline.operators.gates import public_trades
from sightline.plans.correlate import correlate
from sightline.session import apply_defaults, new_folder

# Physical schemas of the given tables, stated so that opening one runs no inference job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

TYPES = {"A": "Purchase", "R": "Sale", "N": "Exchange"}
REGION_OF_LANG = {"en": "AMERICA", "de": "EUROPE", "fr": "AFRICA", "es": "ASIA"}


def _choose(column, mapping: dict[str, str], default=None):
    out = F.lit(default)
    for key, value in mapping.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


class Bound:
    """Entities bound to one folder of tables; frames are built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = apply_defaults(spark)
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read.schema(SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def person(self) -> DataFrame:
        seg = F.col("c_mktsegment")
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("full_name"),
            seg.alias("role"),
            F.when(seg == "MACHINERY", 1.0).when(seg == "BUILDING", 0.8).otherwise(0.6).alias("authority"),
        )

    @cached_property
    def filing(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("person_id"),
            F.date_add(F.to_date("o_orderdate"), 60).alias("filing_date"),
            _choose(F.col("o_orderstatus"), {"F": "published", "O": "parsed", "P": "review"}).alias("status"),
            F.when(F.col("o_orderpriority") == "5-LOW", "annual").otherwise("periodic").alias("form_type"),
            F.when(key % 3 == 0, "primary").otherwise("mirror").alias("source_domain"),
            F.concat(F.lit("https://filings.example/"), key).alias("source_url"),
        )

    @cached_property
    def trade(self) -> DataFrame:
        # by order, so that the join with the filings finds the trades in place
        rows = (
            self.table("lineitem")
            .repartition("l_orderkey")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.min("l_partkey").alias("part_id"),
                F.min("l_suppkey").alias("company_id"),
                F.to_date(F.min("l_shipdate")).alias("date"),
                F.max("l_extendedprice").alias("price"),
                F.min("l_returnflag").alias("flag"),
            )
        )
        band = bands.band_of_amount(F.col("price") * 100)
        return rows.withColumn("band", band).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_linenumber").alias("row_number"),
            F.col("l_orderkey").alias("filing_id"),
            "company_id",
            "part_id",
            F.concat(F.lit("LOT "), F.col("part_id")).alias("description"),
            _choose(F.col("flag"), TYPES).alias("type"),
            "date",
            "band",
            bands.band_min(F.col("band")).alias("amount_min"),
            bands.band_max(F.col("band")).alias("amount_max"),
        )

    @cached_property
    def region_of_supplier(self) -> DataFrame:
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))

    @cached_property
    def company(self) -> DataFrame:
        sector = F.when(F.col("s_suppkey") % 10 != 0, F.col("r_name"))
        return self.region_of_supplier.select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"),
            sector.alias("sector"),
            F.col("n_name").alias("industry"),
            F.array_compact(F.array(sector)).alias("topics"),
        )

    @cached_property
    def action(self) -> DataFrame:
        key = F.col("o_orderkey")
        return (
            self.table("orders")
            .filter(F.col("o_orderpriority") == "1-URGENT")
            .select(
                key.alias("id"),
                F.to_date("o_orderdate").alias("occurred_on"),
                _choose(F.col("o_orderstatus"), {"F": "contract", "O": "rule", "P": "notice"}).alias("action_type"),
                F.concat(F.lit("Order "), key, F.lit(" concerning customer "), F.col("o_custkey")).alias("title"),
                F.concat(F.lit("https://actions.example/"), key).alias("source_url"),
            )
        )

    @cached_property
    def target(self) -> DataFrame:
        urgent = self.table("orders").filter(F.col("o_orderpriority") == "1-URGENT")
        hits = (
            self.table("lineitem")
            .join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
            .select("l_orderkey", "l_suppkey")
            .distinct()
        )
        region = self.region_of_supplier.select(F.col("s_suppkey").alias("l_suppkey"), "r_name")
        by_sector = F.col("l_suppkey") % 10 == 0
        return hits.join(region, "l_suppkey").select(
            F.col("l_orderkey").alias("action_id"),
            F.when(~by_sector, F.col("l_suppkey")).alias("company_id"),
            F.when(by_sector, F.col("r_name")).alias("sector"),
            F.when(by_sector, "sector").otherwise("named").alias("link_method"),
        )

    @cached_property
    def statement(self) -> DataFrame:
        doc = F.col("doc_id")
        return self.table("documents").select(
            doc.alias("id"),
            F.date_add(F.lit("1995-01-01").cast("date"), (doc * 37 % 2500).cast("int")).alias("spoken_at"),
            F.col("source").alias("channel"),
            F.concat_ws(" ", "source", "lang").alias("venue"),
            F.col("text").alias("full_text"),
            F.when(doc % 4 == 0, "caption_derived").otherwise("official_transcript").alias("method"),
            (F.lit(0.5) + (doc % 6) / 10).alias("confidence"),
            F.when(doc % 9 == 0, True).alias("needs_review"),
            F.when((doc % 17 == 0) & (doc > 0), doc - 1).alias("superseded_by"),
            F.concat(F.lit("https://statements.example/"), doc).alias("source_url"),
        )

    @cached_property
    def mention(self) -> DataFrame:
        doc = F.col("doc_id")
        companies = self.table("supplier").agg(F.count(F.lit(1))).scalar()
        labels = self.table("labels").dropDuplicates(["doc_id"])
        labelled = self.table("documents").select("doc_id", "lang").join(labels, "doc_id", "left")
        opinion = (
            F.when(F.col("toxic") == 1, "negative")
            .when(F.col("quality") == 1, "positive")
            .when(F.col("quality").isNotNull(), "neutral")
        )
        method = F.when(doc % 5 == 0, "llm").otherwise("gazetteer")
        named = labelled.select(
            (doc * 2).alias("id"),
            doc.alias("statement_id"),
            (doc % companies).alias("company_id"),
            F.lit(None).cast("string").alias("sector"),
            opinion.alias("sentiment"),
            method.alias("method"),
            F.lit(0.6).alias("confidence"),
            F.lit(0).alias("char_start"),
        )
        topical = labelled.select(
            (doc * 2 + 1).alias("id"),
            doc.alias("statement_id"),
            F.lit(None).cast("bigint").alias("company_id"),
            _choose(F.col("lang"), REGION_OF_LANG).alias("sector"),
            F.when(doc % 7 == 0, "negative").alias("sentiment"),
            F.lit("gazetteer").alias("method"),
            F.lit(0.5).alias("confidence"),
            F.lit(0).alias("char_start"),
        )
        return named.unionByName(topical)

    def correlated(self, trade: DataFrame | None = None, **options) -> DataFrame:
        return correlate(
            self.trade if trade is None else trade, self.filing, self.company, self.person,
            self.statement, self.mention, self.action, self.target, **options,
        )

    @cached_property
    def corr(self) -> DataFrame:
        """Scored pairs with a key and a verdict, as the reads find them."""
        return self.pairs.drop("company_id")

    @cached_property
    def pairs(self) -> DataFrame:
        """`corr` with the company, as a run gives it."""
        return self.pairs_with().select(*self._PAIR)

    _PAIR = ["id", "company_id", "trade_id", "kind", "event_id", "days_gap", "signal", "components", "version", "verified"]

    def pairs_with(self, *carry: str, facts: DataFrame | None = None, trade: DataFrame | None = None, of_company: tuple[str, ...] = ()) -> DataFrame:
        """`pairs` with columns of their trades and companies and facts of their events, of all trades or those given."""
        event = F.col("event_id")
        about = [c for c in facts.columns if c not in ("kind", "event_id")] if facts is not None else []
        return self.correlated(trade=trade, carry=carry, facts=facts, of_company=of_company).select(
            F.concat_ws(":", "trade_id", "kind", "event_id").alias("id"),
            "company_id", "trade_id", "kind", "event_id", "days_gap", "signal", "components", "version",
            F.when(event % 11 == 0, False).when(event % 11 == 1, True).alias("verified"),
            *[f"trade_{c}" for c in carry],
            *[f"company_{c}" for c in of_company],
            *[f"event_{c}" for c in about],
        )

    @cached_property
    def price(self) -> DataFrame:
        views = self.table("events").filter(F.col("event_type") == "view")
        return (
            views.groupBy(F.concat(F.lit("U"), "user_id").alias("ticker"), F.to_date("ts").alias("date"))
            .agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
        )

    @cached_property
    def deal(self) -> DataFrame:
        """Dated purchases of the event stream: the trades of the price series."""
        return self.table("events").filter(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("U"), "user_id").alias("ticker"),
            F.to_date("ts").alias("date"),
            F.col("value").alias("amount"),
        )

    def _named(self, trade: DataFrame) -> DataFrame:
        part = self.table("part").select(
            F.col("p_partkey").alias("part_id"),
            F.concat(F.upper("p_name"), F.lit(" "), F.col("p_type"), F.lit(" COM")).alias("description"),
        )
        return trade.drop("description").join(part, "part_id")

    @cached_property
    def described(self) -> DataFrame:
        """Trades with the printed security name instead of the lot number."""
        return self._named(self.trade)

    @cached_property
    def ours(self) -> DataFrame:
        """`described` trades of released filings as the matching with records finds them: a table
        written once and read several times."""
        rows = self._named(public_trades(self.trade, self.filing))
        return self.written(rows.select("id", "company_id", "description", "date", "amount_min", "amount_max"), "ours")

    @cached_property
    def listed(self) -> DataFrame:
        """Companies with their tickers as a table. The planner knows its size, which it takes for far more
        behind the joins of `company`, so that trades are shuffled to meet it."""
        return self.written(self.company.select("id", "ticker"), "listed")

    def written(self, rows: DataFrame, kind: str) -> DataFrame:
        path = new_folder(self.spark, kind)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


ENTITY_SQL = """
person AS (
  SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS role,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 1.0::DOUBLE WHEN 'BUILDING' THEN 0.8::DOUBLE
      ELSE 0.6::DOUBLE END AS authority
  FROM customer),
filing AS (
  SELECT o_orderkey AS id, o_custkey AS person_id, CAST(o_orderdate AS DATE) + 60 AS filing_date,
    CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'parsed' WHEN 'P' THEN 'review' END AS status,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'annual' ELSE 'periodic' END AS form_type,
    CASE WHEN o_orderkey % 3 = 0 THEN 'primary' ELSE 'mirror' END AS source_domain,
    'https://filings.example/' || o_orderkey AS source_url
  FROM orders),
band AS (
  SELECT * FROM (VALUES (1, 1001, 15000), (2, 15001, 50000), (3, 50001, 100000),
    (4, 100001, 250000), (5, 250001, 500000), (6, 500001, 1000000), (7, 1000001, 5000000),
    (8, 5000001, 25000000), (9, 25000001, 50000000), (10, 50000001, NULL)) b(band, lo, hi)),
trade0 AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS part_id, min(l_suppkey) AS company_id,
    CAST(min(l_shipdate) AS DATE) AS date, max(l_extendedprice) * 100 AS amount, min(l_returnflag) AS flag
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
trade AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS row_number, l_orderkey AS filing_id,
    company_id, part_id, 'LOT ' || part_id AS description,
    CASE flag WHEN 'A' THEN 'Purchase' WHEN 'R' THEN 'Sale' WHEN 'N' THEN 'Exchange' END AS type,
    date, band.band AS band, band.lo::BIGINT AS amount_min, band.hi::BIGINT AS amount_max
  FROM trade0 LEFT JOIN band ON amount >= lo AND amount < coalesce(hi + 1, 1e18)),
described AS (
  SELECT t.* EXCLUDE (description), upper(p_name) || ' ' || p_type || ' COM' AS description
  FROM trade t JOIN part ON p_partkey = t.part_id),
supplier_region AS (
  SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
company AS (
  SELECT s_suppkey AS id, s_name AS name, 'S' || s_suppkey AS ticker,
    CASE WHEN s_suppkey % 10 <> 0 THEN r_name END AS sector, n_name AS industry
  FROM supplier_region),
action AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS occurred_on,
    CASE o_orderstatus WHEN 'F' THEN 'contract' WHEN 'O' THEN 'rule' WHEN 'P' THEN 'notice' END AS action_type,
    'Order ' || o_orderkey || ' concerning customer ' || o_custkey AS title,
    'https://actions.example/' || o_orderkey AS source_url
  FROM orders WHERE o_orderpriority = '1-URGENT'),
target AS (
  SELECT DISTINCT l_orderkey AS action_id, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS company_id,
    CASE WHEN l_suppkey % 10 = 0 THEN r_name END AS sector, l_suppkey AS supplier_id,
    CASE WHEN l_suppkey % 10 = 0 THEN 'sector' ELSE 'named' END AS link_method
  FROM lineitem JOIN supplier_region ON s_suppkey = l_suppkey
  WHERE l_orderkey IN (SELECT id FROM action)),
statement AS (
  SELECT doc_id AS id, DATE '1995-01-01' + CAST(doc_id * 37 % 2500 AS INTEGER) AS spoken_at,
    source AS channel, source || ' ' || lang AS venue, text AS full_text,
    CASE WHEN doc_id % 4 = 0 THEN 'caption_derived' ELSE 'official_transcript' END AS method,
    0.5::DOUBLE + (doc_id % 6) / 10::DOUBLE AS confidence,
    CASE WHEN doc_id % 9 = 0 THEN true END AS needs_review,
    CASE WHEN doc_id % 17 = 0 AND doc_id > 0 THEN doc_id - 1 END AS superseded_by,
    'https://statements.example/' || doc_id AS source_url
  FROM documents),
trusted AS (
  SELECT * FROM statement WHERE superseded_by IS NULL AND (method = 'official_transcript'
    OR (method = 'caption_derived' AND confidence >= 0.8::DOUBLE AND needs_review IS NOT TRUE))),
label1 AS (SELECT doc_id, any_value(quality) AS quality, any_value(toxic) AS toxic FROM labels GROUP BY doc_id),
mention AS (
  SELECT doc_id * 2 AS id, doc_id AS statement_id, doc_id % (SELECT count(*) FROM supplier) AS company_id,
    NULL::VARCHAR AS sector,
    CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality IS NOT NULL THEN 'neutral' END AS sentiment,
    CASE WHEN doc_id % 5 = 0 THEN 'llm' ELSE 'gazetteer' END AS method, 0.6::DOUBLE AS confidence, 0 AS char_start
  FROM documents LEFT JOIN label1 USING (doc_id)
  UNION ALL
  SELECT doc_id * 2 + 1, doc_id, NULL,
    CASE lang WHEN 'en' THEN 'AMERICA' WHEN 'de' THEN 'EUROPE' WHEN 'fr' THEN 'AFRICA' WHEN 'es' THEN 'ASIA' END,
    CASE WHEN doc_id % 7 = 0 THEN 'negative' END, 'gazetteer', 0.5::DOUBLE, 0
  FROM documents),
public_trade AS (
  SELECT t.*, f.person_id, f.filing_date, f.source_url AS filing_url
  FROM trade t JOIN filing f ON f.id = t.filing_id WHERE f.status IN ('parsed', 'published')),
price AS (
  SELECT 'U' || user_id AS ticker, CAST(ts AS DATE) AS date,
    arg_max(value, (ts, event_id)) AS close
  FROM events WHERE event_type = 'view' GROUP BY ALL),
deal AS (
  SELECT event_id AS id, 'U' || user_id AS ticker, CAST(ts AS DATE) AS date, value AS amount
  FROM events WHERE event_type = 'purchase')
"""

CANDIDATE_SQL = """
event_link AS (
  SELECT m.company_id, m.sector AS topic, 'statement' AS kind, s.id AS event_id, s.spoken_at AS event_date,
    NULL::VARCHAR AS action_type
  FROM mention m JOIN trusted s ON s.id = m.statement_id
  UNION ALL
  SELECT g.company_id, g.sector, 'action', a.id, a.occurred_on, a.action_type
  FROM target g JOIN action a ON a.id = g.action_id),
scorable AS (
  SELECT t.id AS trade_id, t.company_id, c.sector AS topic, t.date, t.type, t.band, p.authority
  FROM public_trade t JOIN company c ON c.id = t.company_id LEFT JOIN person p ON p.id = t.person_id),
candidate AS (
  SELECT trade_id, kind, event_id, any_value(company_id) AS company_id, any_value(topic) AS topic,
    any_value(event_date) AS event_date, any_value(action_type) AS action_type, max(specificity) AS specificity
  FROM (
    SELECT t.trade_id, t.company_id, t.topic, e.kind, e.event_id, e.event_date, e.action_type, 1.0::DOUBLE AS specificity
    FROM scorable t JOIN event_link e ON e.company_id = t.company_id
      AND e.event_date BETWEEN t.date - 45 AND t.date + 30
    UNION ALL
    SELECT t.trade_id, t.company_id, t.topic, e.kind, e.event_id, e.event_date, e.action_type, 0.6::DOUBLE
    FROM scorable t JOIN event_link e ON e.topic = t.topic
      AND e.event_date BETWEEN t.date - 45 AND t.date + 30)
  GROUP BY trade_id, kind, event_id),
pair_sentiment AS (
  SELECT DISTINCT ON (k.company_id, k.event_id) k.company_id, k.event_id, m.sentiment
  FROM (SELECT DISTINCT company_id, topic, event_id FROM candidate WHERE kind = 'statement') k
  JOIN mention m ON m.statement_id = k.event_id AND (m.company_id = k.company_id OR m.sector = k.topic)
  WHERE m.sentiment IS NOT NULL
  ORDER BY k.company_id, k.event_id, m.method <> 'llm', m.confidence DESC, m.char_start, m.id),
component AS (
  SELECT c.trade_id, c.company_id, c.kind, c.event_id, date_diff('day', t.date, c.event_date) AS days_gap,
    floor(exp(-abs(date_diff('day', t.date, c.event_date)) / 14.0::DOUBLE) * 1000 + 0.5) / 1000 AS temporal,
    c.specificity, coalesce(t.authority, 1.0::DOUBLE) AS authority,
    CASE WHEN t.type NOT IN ('Purchase', 'Sale') THEN 0.5::DOUBLE
      WHEN c.kind = 'statement' AND s.sentiment = 'positive' OR c.action_type = 'contract'
        THEN CASE WHEN t.type = 'Purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
      WHEN c.kind = 'statement' AND s.sentiment = 'negative'
        THEN CASE WHEN t.type = 'Sale' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
      ELSE 0.5::DOUBLE END AS direction,
    floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (ln(CASE WHEN b.hi IS NULL THEN b.lo ELSE floor((b.lo + b.hi) / 2.0::DOUBLE + 0.5) END)
      - ln(8000.0::DOUBLE)) / (ln(50000000.0::DOUBLE) - ln(8000.0::DOUBLE)))) * 1000 + 0.5) / 1000 AS magnitude,
    least(1.0::DOUBLE, (count(*) OVER (PARTITION BY c.trade_id) - 1) * 0.25::DOUBLE) AS corroboration
  FROM candidate c JOIN scorable t USING (trade_id) JOIN band b ON b.band = t.band
  LEFT JOIN pair_sentiment s ON c.kind = 'statement' AND s.company_id = c.company_id AND s.event_id = c.event_id),
scored AS (
  SELECT *, floor((0.3::DOUBLE * temporal + 0.25::DOUBLE * specificity + 0.1::DOUBLE * authority
    + 0.1::DOUBLE * direction + 0.1::DOUBLE * magnitude + 0.15::DOUBLE * corroboration) * 1000 + 0.5) / 10 AS signal
  FROM component),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY signal DESC, specificity DESC, kind DESC, event_id) AS pos
  FROM scored WHERE signal >= {threshold})
"""

CORR_SQL = """
corr AS MATERIALIZED (
  SELECT concat_ws(':', trade_id, kind, event_id) AS id, trade_id, kind, event_id, days_gap, signal,
    CASE WHEN event_id % 11 = 0 THEN false WHEN event_id % 11 = 1 THEN true END AS verified
  FROM ranked WHERE pos <= {cap})
"""


def with_entities(query: str) -> str:
    """SQL over the entity projections; the first own CTE of `query` may follow with WITH."""
    return _prefix(ENTITY_SQL, query)


def with_correlations(query: str, threshold: float = 25, cap: int = 25) -> str:
    head = ",".join([ENTITY_SQL, CANDIDATE_SQL, CORR_SQL])
    return _prefix(head.replace("{threshold}", str(threshold)).replace("{cap}", str(cap)), query)


def _prefix(head: str, query: str) -> str:
    body = query.strip()
    if body.split(None, 1)[0].upper() == "WITH":
        return f"WITH {head},\n{body[4:]}"
    return f"WITH {head}\n{body}"
