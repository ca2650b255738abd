"""Company names and security descriptions: keys, normal forms and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .numeric import let


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _clean_upper(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9 ]", " ")


def match_key(name: Column) -> Column:
    """What a text must contain to mention the company: one distinctive word, or the first
    two of them as a phrase; NULL when nothing distinctive is left."""
    kept = F.filter(
        _words(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " ")),
        lambda w: (F.length(w) >= 4) & ~w.isin(fixed.GENERIC_NAME_WORDS),
    )

    def key(words: Column) -> Column:
        first, second = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
        alone = F.when((F.length(first) >= 5) & ~first.isin(fixed.WEAK_SOLO_TOKENS), first)
        phrase = F.concat_ws(" ", first, second)
        return F.when(F.size(words) == 1, alone).when(F.size(words) >= 2, phrase)

    return let(kept, key)


def usable_ticker(ticker: Column) -> Column:
    """Tickers that may be matched (as $TICKER only)."""
    return (F.length(ticker) >= 2) & ~F.upper(ticker).isin(fixed.TICKER_STOPWORDS)


def normalize_name(name: Column) -> Column:
    """Upper case, abbreviations spelled out, legal and share-class words dropped."""
    table = F.create_map(*[F.lit(x) for pair in fixed.NAME_ABBREVIATIONS.items() for x in pair])
    spelled = F.transform(_words(_clean_upper(name)), lambda w: F.coalesce(F.try_element_at(table, w), w))
    kept = F.filter(spelled, lambda w: ~w.rlike(f"^(?:{fixed.NAME_NOISE})$"))
    return F.array_join(kept, " ")


def normalize_description(text: Column) -> Column:
    """Upper case, words of letters and digits, corporate words dropped. Plain replacements, for this is
    computed for every row of two sides."""
    spaced = F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " ")
    return F.trim(F.regexp_replace(spaced, f"(?<![^ ])(?:{fixed.DESCRIPTION_NOISE})(?![^ ]) ?", ""))


def distinctive_tokens(name: Column) -> Column:
    return F.filter(
        _words(_clean_upper(name)),
        lambda w: (F.length(w) >= 4) & ~w.isin(fixed.STRUCTURAL_WORDS),
    )


def recipient_key(name: Column) -> Column:
    """Search text for a company: its first two distinctive words."""
    return F.array_join(F.slice(distinctive_tokens(name), 1, 2), " ")


def code_to_sector(code: Column) -> Column:
    """Sector of a four-digit industry code; codes outside every range are 'Other'."""
    out = F.lit("Other")
    for low, high, sector in reversed(fixed.CODE_SECTORS):
        hit = code >= low if high is None else code.between(low, high)
        out = F.when(hit, F.lit(sector)).otherwise(out)
    return F.when(code.isNotNull(), out)


def is_non_equity(description: Column) -> Column:
    return description.rlike(fixed.NON_EQUITY)


def company_topics(industry: Column, sector: Column) -> Column:
    """Topics whose industry pattern occurs in the company's industry and sector text."""
    text = F.concat_ws(" ", F.coalesce(industry, F.lit("")), F.coalesce(sector, F.lit("")))
    hits = [F.when(text.rlike(f"(?i){pattern}"), F.lit(topic)) for topic, _, _, pattern in fixed.TOPICS]
    return F.array_compact(F.array(*hits))


def topic_label(topic: Column) -> Column:
    out = F.regexp_replace(topic, "_", " ")
    for name, label, _, _ in fixed.TOPICS:
        out = F.when(topic == name, F.lit(label)).otherwise(out)
    return out
