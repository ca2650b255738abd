"""Statutory amount bands: only a range is ever disclosed, never an exact figure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import let

# Lower bounds of the ten bands. A band ends where the next one starts;
# the last one has no upper bound.
BAND_MINIMUMS = [
    1001, 15001, 50001, 100001, 250001, 500001, 1000001, 5000001, 25000001, 50000001,
]
BAND_COUNT = len(BAND_MINIMUMS)
BAND_MAXIMUMS: list[int | None] = [low - 1 for low in BAND_MINIMUMS[1:]] + [None]
# Dash variants that separate the two ends of a printed range.
DASHES = "\\-\u2022\u2013\u2014~"


def _pick(band: Column, values: list) -> Column:
    """Value at a 1-based band position; NULL for a band that does not exist."""
    table = F.array(*[F.lit(v).cast("bigint") for v in values])
    return F.try_element_at(table, F.when(band.between(1, len(values)), band).cast("int"))


def band_min(band: Column) -> Column:
    return _pick(band, BAND_MINIMUMS)


def band_max(band: Column) -> Column:
    return _pick(band, BAND_MAXIMUMS)


def band_midpoint(band: Column) -> Column:
    """Rounded middle of the range; the open top band counts with its lower bound."""
    mids = [
        low if high is None else (low + high + 1) // 2
        for low, high in zip(BAND_MINIMUMS, BAND_MAXIMUMS)
    ]
    return _pick(band, mids)


def band_of_amount(amount: Column) -> Column:
    """The band whose lower bound is the largest one not above the amount."""
    result = F.lit(None).cast("int")
    for number, low in enumerate(BAND_MINIMUMS, start=1):
        result = F.when(amount >= F.lit(low), F.lit(number)).otherwise(result)
    return result


def band_label(band: Column) -> Column:
    low = F.format_number(band_min(band), 0)
    high = F.format_number(band_max(band), 0)
    top = F.concat(F.lit("Over $"), F.format_number(band_min(band) - 1, 0))
    return F.when(
        band_max(band).isNotNull(), F.concat(F.lit("$"), low, F.lit(" – $"), high)
    ).when(band_min(band).isNotNull(), top)


def _short_dollars(value: Column) -> Column:
    millions = F.regexp_replace((value / 1_000_000).cast("decimal(18,3)").cast("string"), r"\.?0+$", "")
    return (
        F.when(value >= 1_000_000, F.concat(F.lit("$"), millions, F.lit("M")))
        .when(value >= 1_000, F.concat(F.lit("$"), half_thousand(value), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), value.cast("string")))
    )


def half_thousand(value: Column) -> Column:
    return F.floor(value / 1_000 + 0.5).cast("bigint").cast("string")


def band_short_label(band: Column) -> Column:
    low = _short_dollars(band_min(band) - 1)
    return F.when(
        band_max(band).isNotNull(),
        F.concat(low, F.lit(" – "), _short_dollars(band_max(band))),
    ).when(band_min(band).isNotNull(), F.concat(F.lit("Over "), low))


# What a printed range and an open-ended amount look like on a scanned page.
RANGE_PATTERN = rf"[$Ss5]?\s?\d[\d,. ]{{2,}}\s*[{DASHES}]\s*[$Ss5]?\s?\d[\d,. ]{{2,}}"
OVER_PATTERN = r"[Oo0][vV][eE3]r\s+[$Ss5]?\s?5[\d,. ]{6,}"


def band_of_text(text: Column) -> Column:
    """Band of the first printed amount in a noisy text, NULL when there is none.

    A range is identified by the digits of its lower end only, the longest lower bound
    first; whichever of range and open-ended amount starts first decides.
    """
    low_end = F.regexp_extract(F.regexp_extract(text, f"({RANGE_PATTERN})", 1), rf"^([^{DASHES}]*)", 1)

    def by_digits(digits: Column) -> Column:
        band = F.lit(None).cast("int")
        for number, low in enumerate(BAND_MINIMUMS, start=1):  # ascending, so the longest key is tested first
            band = F.when(digits.endswith(F.lit(str(low))), F.lit(number)).otherwise(band)
        return band

    def decided(at: Column) -> Column:
        over_first = (at["over"] > 0) & ((at["range"] == 0) | (at["over"] < at["range"]))
        return F.when(over_first, F.lit(BAND_COUNT)).when(at["range"] > 0, let(F.regexp_replace(low_end, "[^0-9]", ""), by_digits))

    places = F.struct(
        F.regexp_instr(text, F.lit(f"({RANGE_PATTERN})")).alias("range"), F.regexp_instr(text, F.lit(f"({OVER_PATTERN})")).alias("over")
    )
    return let(places, decided)
