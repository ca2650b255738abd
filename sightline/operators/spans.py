"""Mentions of companies and topics in texts, with verified spans.

The dictionary is never crossed with the texts, and texts are never shuffled: each is tokenised
once into distinct words and adjacent word pairs, those that a filter of the dictionary's terms
lets through are located in the same pass, and only spans with their quotes meet the dictionary in
an equi-join. Offsets count code points, start inclusive, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, names
from ..functions.numeric import let
from ..functions.text import adjacent_pairs, ascii_bounded, trimmed
from .membership import key_filter, may_hold

CONTEXT = 80
COMPANY_CONFIDENCE, TOPIC_CONFIDENCE, METHOD = 0.6, 0.5, "gazetteer"


def build_gazetteer(company: DataFrame) -> DataFrame:
    """(company_id, ticker, name_key) of companies; either key may be missing."""
    return company.select(
        F.col("id").alias("company_id"), "ticker", names.match_key(F.col("name")).alias("name_key")
    )


def _terms(text: Column) -> Column:
    """Distinct lower-case words, blank-separated word pairs and $tickers of a text."""
    runs = F.filter(F.split(F.lower(text), r"[^a-z0-9_\s]+"), lambda r: r.rlike("[a-z0-9_]"))

    def of_run(run: Column) -> Column:
        words = F.filter(F.split(run, r"\s+"), lambda w: w != "")
        return let(words, lambda w: F.concat(w, adjacent_pairs(w)))

    cashtags = F.regexp_extract_all(text, F.lit(r"\$[A-Za-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.concat(F.flatten(F.transform(runs, of_run)), cashtags))


def _quoted(literal: Column) -> Column:
    return F.regexp_replace(literal, r"([^A-Za-z0-9_ ])", r"\\$1")


def gazetteer_terms(gazetteer: DataFrame) -> DataFrame:
    """One row per (company, term)."""
    cash = gazetteer.filter(names.usable_ticker(F.col("ticker"))).select(
        "company_id", F.concat(F.lit("$"), "ticker").alias("term")
    )
    named = gazetteer.filter(F.col("name_key").isNotNull()).select("company_id", F.col("name_key").alias("term"))
    return cash.unionByName(named)


def term_pattern(term: Column) -> Column:
    """The pattern that locates a term in a text: $tickers as written, names in any case and with
    any white space between their words."""
    end = F.lit("(?![A-Za-z0-9_])")
    named = F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), F.regexp_replace(term, " ", r"\\s+"), end)
    return F.when(F.startswith(term, F.lit("$")), F.concat(_quoted(term), end)).otherwise(named)


def locate(text: Column, pattern: Column) -> Column:
    """Array of (char_start, char_end, match) of all matches of a pattern in a text."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def span(match: Column, at: Column, sizes: Column, widths: Column) -> Column:
        add = lambda total, x: total + x
        start = F.aggregate(F.slice(sizes, F.lit(1), at + 1), F.lit(0), add) + F.aggregate(
            F.slice(widths, F.lit(1), at), F.lit(0), add
        )
        return F.struct(start.alias("char_start"), (start + F.length(match)).alias("char_end"), match.alias("match"))

    def all_spans(matches: Column) -> Column:
        return let(gaps, lambda sizes: let(
            F.transform(matches, F.length),
            lambda widths: F.transform(matches, lambda m, at: span(m, at, sizes, widths)),
        ))

    return let(found, all_spans)


def context(text: Column) -> Column:
    """The span with up to 80 characters on each side, trimmed."""
    low = F.greatest(F.col("char_start") - CONTEXT, F.lit(0))
    return trimmed(F.substring(text, low + 1, F.col("char_end") + CONTEXT - low))


def _verified(df: DataFrame, text: str) -> DataFrame:
    """Only spans that are found again at their offsets."""
    again = F.substring(text, F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return df.filter(again == F.col("match"))


def _known_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text, term) of the terms of texts that may be in the dictionary."""
    known = key_filter(terms, "term")
    found = texts.select("doc_id", "text", F.explode(_terms(F.col("text"))).alias("term"))
    return found.filter(may_hold(known, F.col("term")))


def company_hits(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(doc_id, company_id) of texts (doc_id, text) that contain a company's term, per term."""
    terms = gazetteer_terms(gazetteer)
    return _known_terms(texts, terms).select("doc_id", "term").join(terms, "term").select("doc_id", "company_id")


def find_company_spans(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """All spans naming a company, one per (text, company, start)."""
    terms = gazetteer_terms(gazetteer)
    spans = _known_terms(texts, terms).select(
        "doc_id", "term", "text", F.explode(locate(F.col("text"), term_pattern(F.col("term")))).alias("span")
    )
    quoted = _verified(spans.select("doc_id", "term", "text", "span.*"), "text").select(
        "doc_id", "term", "char_start", "char_end", context(F.col("text")).alias("quote")
    )
    return (
        quoted.join(terms, "term")
        .groupBy("doc_id", "company_id", "char_start")
        .agg(F.max_by("quote", "char_end").alias("quote"), F.max("char_end").alias("char_end"))
        .withColumns({"confidence": F.lit(COMPANY_CONFIDENCE), "method": F.lit(METHOD)})
    )


def find_topic_spans(texts: DataFrame, topics: list[tuple[str, str]] | None = None) -> DataFrame:
    """The first span of every topic in a text. Topics are a fixed short list, so all
    patterns are tried in one pass over each text."""
    topics = topics or [(name, pattern) for name, _, pattern, _ in fixed.TOPICS]
    first = []
    for name, pattern in topics:
        full = "(?i)" + ascii_bounded(f"({pattern})")
        at = F.regexp_instr("text", F.lit(full)) - 1
        match = F.regexp_extract("text", full, 1)
        first.append(
            F.when(match != "", F.struct(F.lit(name).alias("topic"), at.alias("char_start"), match.alias("match")))
        )
    return (
        texts.select("doc_id", "text", F.explode(F.array_compact(F.array(*first))).alias("hit"))
        .select("doc_id", "text", "hit.*")
        .withColumn("char_end", F.col("char_start") + F.length("match"))
        .transform(_verified, "text")
        .select(
            "doc_id", "topic", "char_start", "char_end",
            context(F.col("text")).alias("quote"),
            F.lit(TOPIC_CONFIDENCE).alias("confidence"), F.lit(METHOD).alias("method"),
        )
    )


def link_actions(
    action: DataFrame, gazetteer: DataFrame, preserved: DataFrame, topics: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Links of actions (action_id, title, summary) by name and by topic over title and
    summary; pairs that are already linked authoritatively are kept and not linked again."""
    texts = action.select(
        F.col("action_id").alias("doc_id"),
        F.concat_ws("\n", "title", F.coalesce("summary", F.lit(""))).alias("text"),
    )
    named = (
        company_hits(texts, gazetteer)
        .select(F.col("doc_id").alias("action_id"), "company_id")
        .distinct()
        .join(preserved.select("action_id", "company_id"), ["action_id", "company_id"], "left_anti")
        .select(
            "action_id", "company_id", F.lit(None).cast("string").alias("sector"),
            F.lit("named").alias("link_method"), F.lit(COMPANY_CONFIDENCE).alias("confidence"),
        )
    )
    topical = find_topic_spans(texts, topics).select(
        F.col("doc_id").alias("action_id"),
        F.lit(None).cast(named.schema["company_id"].dataType).alias("company_id"),
        F.col("topic").alias("sector"), F.lit("sector").alias("link_method"), "confidence",
    )
    return named.unionByName(topical)


def verify_quote(text: Column, quote: Column) -> Column:
    """(char_start, char_end) of the first verbatim occurrence; NULL when it is not there."""
    wanted = trimmed(quote)

    def found(q: Column) -> Column:
        return let(F.instr(text, q), lambda at: F.when(
            (F.length(q) >= 3) & (at > 0),
            F.struct((at - 1).alias("char_start"), (at - 1 + F.length(q)).alias("char_end")),
        ))

    return let(wanted, found)


def clean_labels(labels: DataFrame) -> DataFrame:
    """Whitelist sentiment and stance of proposed mentions and clamp their confidence."""
    # The two vocabularies.
    sentiments = ["positive", "negative", "neutral"]
    stances = ["praise", "attack", "policy", "tariff", "contract", "regulation", "endorsement", "other"]
    return labels.withColumns(
        {
            "sentiment": F.when(F.col("sentiment").isin(sentiments), F.col("sentiment")),
            "stance": F.when(F.col("stance").isin(stances), F.col("stance")),
            "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))),
        }
    )


def apply_labels(mention, labels, statement, company, cap: int = 20) -> DataFrame:
    """Overlay proposed mentions (statement_id, seq, ticker, quote, sentiment, stance,
    confidence) on detected ones.

    Unknown tickers and quotes that are not in the text are dropped; only the first `cap`
    proposals of a statement count, that being what one model answer may hold. A company
    already mentioned in the statement gets the last proposal's sentiment and stance, else
    the first proposal is added as a new mention, restyled by the later ones.
    """
    first = Window.partitionBy("statement_id").orderBy("seq")
    firm = company.select(F.upper("ticker").alias("ticker"), F.col("id").alias("company_id"))
    text = statement.select(F.col("id").alias("statement_id"), "full_text")
    valid = (
        clean_labels(labels)
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= cap)
        .withColumn("ticker", F.upper("ticker"))
        .join(firm, "ticker")
        .join(text, "statement_id")
        .withColumn("span", verify_quote(F.col("full_text"), F.col("quote")))
        .filter(F.col("span").isNotNull())
        .groupBy("statement_id", "company_id")
        .agg(
            F.max_by(F.struct("sentiment", "stance"), "seq").alias("label"),
            F.min_by(F.struct("span", "confidence"), "seq").alias("first"),
        )
    )
    pair = ["statement_id", "company_id"]
    known = mention.join(valid.select(*pair, "label"), pair, "left")
    enriched = F.col("label").isNotNull()
    kept = known.select(
        *pair, "char_start", "char_end", "confidence", "method",
        F.when(enriched, F.col("label.sentiment")).otherwise(F.col("sentiment")).alias("sentiment"),
        F.when(enriched, F.col("label.stance")).otherwise(F.col("stance")).alias("stance"),
    )
    added = valid.join(mention.select(*pair), pair, "left_anti").select(
        *pair, "first.span.char_start", "first.span.char_end", "first.confidence",
        F.lit("llm").alias("method"), "label.sentiment", "label.stance",
    )
    return kept.unionByName(added)


def redetect(stored: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """Mentions after a new detection over `texts` (doc_id): rows of the gazetteer for these texts
    are replaced by `found`, rows of other methods and of other texts stay. Columns are those of
    `stored`; what `found` lacks is NULL."""
    stale = F.col("method") == METHOD
    again = texts.select("doc_id").distinct()
    kept = stored.filter(~stale | stale.isNull()).unionByName(stored.filter(stale).join(again, "doc_id", "left_anti").select(*stored.columns))
    return kept.unionByName(found.select(*[c for c in stored.columns if c in found.columns]), allowMissingColumns=True)
