"""Dates, durations and addresses found in text. Whatever is implausible becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def long_date(text: Column) -> Column:
    """First 'January 5, 2025' in the text."""
    pattern = rf"(?i)(?<![A-Za-z0-9_])({fixed.MONTHS})\s+(\d{{1,2}}),\s+(\d{{4}})(?![A-Za-z0-9_])"
    month, day, year = (F.regexp_extract(text, pattern, g) for g in (1, 2, 3))
    number = F.lit(None).cast("int")
    for at, name in enumerate(fixed.MONTHS.split("|"), start=1):
        number = F.when(F.lower(month) == name.lower(), F.lit(at)).otherwise(number)
    return _date(year, number.cast("string"), day)


def dotted_date(text: Column) -> Column:
    """M.D.YY or M.D.YYYY as used in file names; two-digit years are 20xx."""
    pattern = r"(\d{1,2})\.(\d{1,2})\.(\d{2,4})"
    month, day, year = (F.regexp_extract(text, pattern, g) for g in (1, 2, 3))
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).when(F.length(year) == 4, year)
    return _date(full, month, day)


def iso_or_us_date(text: Column) -> Column:
    """First ISO date, else first M/D/YYYY."""
    edge, end = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    iso = F.regexp_extract(text, rf"{edge}(\d{{4}}-\d{{2}}-\d{{2}}){end}", 1)
    us = rf"{edge}(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){end}"
    month, day, year = (F.regexp_extract(text, us, g) for g in (1, 2, 3))
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).otherwise(_date(year, month, day))


def path_month(url: Column) -> Column:
    """First day of the /YYYY/MM/ part of an address."""
    year, month = (F.regexp_extract(url, r"/(\d{4})/(\d{2})/", g) for g in (1, 2))
    return _date(year, month, F.lit("1"))


def iso_duration_seconds(text: Column) -> Column:
    """PT1H2M3S in seconds; zero and malformed values are NULL."""
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    total = F.lit(0).cast("bigint")
    for group, weight in ((1, 3600), (2, 60), (3, 1)):
        part = F.coalesce(F.regexp_extract(text, pattern, group).try_cast("bigint"), F.lit(0))
        total = total + part * weight
    return F.when(text.rlike(pattern), F.nullif(total, F.lit(0).cast("bigint")))


def url_host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("unknown"))


def url_file_name(url: Column) -> Column:
    path = F.regexp_replace(url, r"[?#].*$", "")
    return F.try_url_decode(F.element_at(F.split(path, "/"), -1))


def disclosure_lag(filed: Column, traded: Column) -> Column:
    """Days from a trade to its filing; NULL where the filing comes first."""
    lag = F.datediff(filed, traded)
    return F.when(lag >= 0, lag)
