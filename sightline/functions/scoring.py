"""The six-component signal of a (trade, event) pair, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bands import band_midpoint
from .numeric import clamp, half_up

# Published model version, weights and constants.
SCORING_VERSION = "1.2"
WEIGHTS = {
    "temporal": 0.3,
    "specificity": 0.25,
    "authority": 0.1,
    "direction": 0.1,
    "magnitude": 0.1,
    "corroboration": 0.15,
}
TAU_DAYS = 14
MAGNITUDE_LOW, MAGNITUDE_HIGH = 8_000.0, 50_000_000.0
CORROBORATION_STEP = 0.25
STEP = 0.001  # published signals are sums rounded to this step
DIRECT, TOPICAL = 1.0, 0.6
WINDOW_BEFORE, WINDOW_AFTER = 45, 30
THRESHOLD, MAX_PER_TRADE = 25.0, 25

COMPONENTS = list(WEIGHTS)


def corroboration_saturation() -> int:
    """Number of events from which the corroboration bonus no longer grows."""
    return math.ceil(1 / CORROBORATION_STEP) + 1


def temporal(gap_days: Column, tau: int = TAU_DAYS) -> Column:
    return half_up(F.exp(-F.abs(gap_days) / F.lit(float(tau))), 3)


def magnitude(band: Column) -> Column:
    span = math.log(MAGNITUDE_HIGH) - math.log(MAGNITUDE_LOW)
    share = (F.ln(band_midpoint(band).cast("double")) - F.lit(math.log(MAGNITUDE_LOW))) / F.lit(span)
    return half_up(clamp(share), 3)


def corroboration(events: Column) -> Column:
    return clamp((events - 1) * F.lit(CORROBORATION_STEP))


def trade_side(trade_type: Column) -> Column:
    """+1 buy, -1 sell, 0 for anything without a direction."""
    return (
        F.when(trade_type.startswith("Purchase"), F.lit(1))
        .when(trade_type.startswith("Sale"), F.lit(-1))
        .otherwise(F.lit(0))
    )


def event_impact(kind: Column, sentiment: Column, action_type: Column) -> Column:
    """+1 favourable, -1 unfavourable, 0 unknown. An awarded contract is favourable."""
    return (
        F.when((kind == "statement") & (sentiment == "positive"), F.lit(1))
        .when((kind == "statement") & (sentiment == "negative"), F.lit(-1))
        .when((kind == "action") & (action_type == "contract"), F.lit(1))
        .otherwise(F.lit(0))
    )


def direction(side: Column, impact: Column) -> Column:
    """1 aligned, 0 opposite, 0.5 when either side is unknown."""
    return (
        F.when(side * impact == 0, F.lit(0.5))
        .when(side == impact, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def steps(components: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum in the published order, as a whole number of steps."""
    total = None
    for name, weight in weights.items():
        term = F.lit(weight) * components[name]
        total = term if total is None else total + term
    return F.floor(total * 1000 + 0.5)


def of_steps(number: Column) -> Column:
    """Steps as a signal of 0..100 with one decimal."""
    return number / 10


def signal(components: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum in the published order, scaled to 0..100 with one decimal."""
    return of_steps(steps(components, weights))
