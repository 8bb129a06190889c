"""Prices: cents, recent medians, downtrends and the pricing guardrails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Windows of a sales-history record, newest first.
WINDOWS = ["last_24_hours", "last_7_days", "last_30_days", "last_90_days"]

# Guardrail constants.
LOW_DISCOUNT, HIGH_DISCOUNT, DEFAULT_DISCOUNT = 0.25, 0.35, 0.30
PREMIUM_TYPES = ["Knife", "Glove"]
COSMETIC_TYPES = ["Sticker", "Patch"]
PREMIUM_PRICE_CENTS = 15000
PREMIUM_VOLUME_FLOOR, VOLUME_FLOOR = 0.05, 0.5
REGIME_DEVIATION = 0.35
BASE_FACTOR, MAX_PENALTY = 0.85, 0.15


def half_even(value: Column) -> Column:
    """Round to an integer, ties to even; null when it is beyond the integers."""
    return F.rint(value).try_cast("bigint")


def to_cents(usd: Column) -> Column:
    return half_even(usd.cast("double") * F.lit(100))


def epoch_to_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def _median(history: Column, window: str) -> Column:
    # zero and non-numeric medians count as missing
    return F.nullif(history[window]["median"].try_cast("double"), F.lit(0.0))


def recent_median(history: Column) -> Column:
    """USD median of the newest window with sales; the 90-day one needs no volume."""
    day, week, month, quarter = (_median(history, w) for w in WINDOWS)

    def sold(window: str) -> Column:
        return F.coalesce(history[window]["volume"], F.lit(0)) > 0

    return F.coalesce(
        F.when(sold(WINDOWS[0]), day),
        F.when(sold(WINDOWS[1]), week),
        F.when(sold(WINDOWS[2]), month),
        quarter,
    )


def downtrend(history: Column) -> Column:
    """Struct (detected, severity): week below month plus day below week, relative drops."""
    day, week, month, quarter = (_median(history, w) for w in WINDOWS)
    recent, older = F.coalesce(week, day), F.coalesce(month, quarter)

    def drop(low: Column, high: Column) -> Column:
        return F.when(low < high, F.try_divide(high - low, high))

    medium, short = drop(recent, older), drop(day, week)
    return F.struct(
        (medium.isNotNull() | short.isNotNull()).alias("detected"),
        (F.coalesce(medium, F.lit(0.0)) + F.coalesce(short, F.lit(0.0))).alias("severity"),
    )


def discount_corridor(item_type: Column) -> Column:
    return (
        F.when(item_type.isin(PREMIUM_TYPES), F.lit(LOW_DISCOUNT))
        .when(item_type.isin(COSMETIC_TYPES), F.lit(HIGH_DISCOUNT))
        .otherwise(F.lit(DEFAULT_DISCOUNT))
    )


def is_liquid(has_baseline: Column, latest: Column, avg_volume: Column, item_type: Column) -> Column:
    """False only when a baseline exists and its volume is below the floor of its class."""
    floor = F.when(
        F.coalesce(latest > PREMIUM_PRICE_CENTS, F.lit(False)) | item_type.isin(PREMIUM_TYPES),
        F.lit(PREMIUM_VOLUME_FLOOR),
    ).otherwise(F.lit(VOLUME_FLOOR))
    return ~(has_baseline & F.coalesce(avg_volume < floor, F.lit(False)))


def regime_shift(steam_avg: Column, reference: Column, discount: Column) -> Column:
    """Discounted long-term average deviates by more than 35 % from the live reference."""
    expected = steam_avg * (F.lit(1.0) - discount)
    deviation = F.when(reference > 0, F.try_divide(F.abs(expected - reference), reference)).otherwise(F.lit(0.0))
    return F.when(steam_avg.isNull() | reference.isNull(), F.lit(False)).otherwise(deviation > REGIME_DEVIATION)


def cash_equivalent(
    liquid: Column, median_cents: Column, steam_avg: Column, source_avg: Column, shift: Column, discount: Column
) -> Column:
    """Live median, else discounted long-term average unless shifted, else source average."""
    return F.when(
        liquid,
        F.coalesce(
            median_cents,
            F.when(~shift, half_even(steam_avg * (F.lit(1.0) - discount))),
            half_even(source_avg),
        ),
    )


def snipe_threshold(cash_cents: Column, falling: Column, severity: Column) -> Column:
    penalty = F.when(falling, F.least(F.lit(MAX_PENALTY), severity)).otherwise(F.lit(0.0))
    return half_even(cash_cents * (F.lit(BASE_FACTOR) - penalty))
