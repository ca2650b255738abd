"""Wording of figures as shown to readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signal_tier(signal: Column) -> Column:
    return F.when(signal >= 60, "high").when(signal >= 40, "medium").otherwise("low")


def gap_phrase(days: Column) -> Column:
    count = F.abs(days).cast("string")
    return (
        F.when(days == 0, "same day as the trade")
        .when(days > 0, F.concat(count, F.lit(" days after the trade")))
        .otherwise(F.concat(count, F.lit(" days before the trade")))
    )


def event_label(kind: Column, action_type: Column, communication_prefix: str) -> Column:
    """Talking is not acting: communications of the administration get their own label."""
    return (
        F.when(kind == "statement", "Public statement")
        .when(action_type.startswith(communication_prefix), "Administration communication")
        .when(action_type == "contract", "Federal contract award")
        .otherwise("Official action")
    )


def coarse_dollars(amount: Column) -> Column:
    def scaled(unit: float, digits: int, suffix: str) -> Column:
        return F.format_string(f"$%.{digits}f{suffix}", amount / F.lit(unit))

    return (
        F.when(amount >= 1_000_000_000, scaled(1e9, 1, "B"))
        .when(amount >= 1_000_000, scaled(1e6, 1, "M"))
        .when(amount >= 1_000, scaled(1e3, 0, "K"))
        .otherwise(F.concat(F.lit("$"), amount.cast("string")))
    )


def day_label(day: Column) -> Column:
    """'Jan 5, 2025'; days are calendar days and never shifted by a zone."""
    return F.date_format(day, "MMM d, yyyy")
