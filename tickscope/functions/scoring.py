"""Tick scoring: z-score with a macro prior, trigger and trade rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tuning:
    """Detection parameters (fixed values are the defaults)."""

    min_savings_cents: int = 50
    z_threshold: float = -2.0
    z_sticker_threshold: float = -1.0
    min_std_factor: float = 0.04
    min_history_points: int = 4
    macro_fallback: bool = True
    macro_prior_weight: float = 5.0
    window_size: int = 20
    dedup_window_s: int = 300


DEFAULTS = Tuning()

# Rule limits.
MACRO_MIN_STD_FACTOR = 0.01
SIGMA_LIMIT = 2.0
STICKER_VALUE_LIMIT = 10000
STICKER_PREMIUM_PERCENT = 3.0


def sample_variance(n: Column, total: Column, squares: Column) -> Column:
    """(n - 1) variance from integer moments; exact before the single division. Null for n < 2."""
    wide = lambda c: c.cast("decimal(38,0)")
    numerator = (wide(squares) * n.cast("decimal(19,0)") - wide(total) * wide(total)).cast("double")
    return F.try_divide(numerator, (n * (n - 1)).cast("double"))


def z_score(
    price: Column,
    n: Column,
    total: Column,
    squares: Column,
    macro_avg: Column,
    macro_vol: Column,
    macro_cv: Column,
    tuning: Tuning = DEFAULTS,
) -> Column:
    """Struct (z, mean, source) of ``price`` against ``n`` earlier prices given by their moments.

    ``n``/``total``/``squares`` exclude the current price. Null when there is neither enough
    history nor a usable macro baseline.
    """
    usable = F.coalesce((macro_vol > 0) & (macro_avg > 0), F.lit(False)) & F.lit(tuning.macro_fallback)
    macro_sigma = F.greatest(macro_vol.cast("double"), macro_avg * F.lit(MACRO_MIN_STD_FACTOR))

    mean = F.try_divide(total.cast("double"), n.cast("double"))
    variance = F.coalesce(sample_variance(n, total, squares), F.lit(0.0))
    prior = mean * macro_cv
    weight = F.lit(tuning.macro_prior_weight)
    blended = F.sqrt((n * variance + weight * (prior * prior)) / (n + weight))
    regular = F.greatest(F.sqrt(variance), mean * F.lit(tuning.min_std_factor))
    hybrid = usable & F.coalesce(macro_cv > 0, F.lit(False))

    def scored(z: Column, centre: Column, source: str) -> Column:
        return F.struct(z.alias("z"), centre.alias("mean"), F.lit(source).alias("source"))

    sparse = n < tuning.min_history_points - 1
    return (
        F.when(sparse & usable, scored(F.try_divide(price - macro_avg, macro_sigma), macro_avg.cast("double"), "macro"))
        .when(sparse, F.lit(None))
        .when(hybrid, scored(F.try_divide(price - mean, blended), mean, "hybrid"))
        .otherwise(scored(F.try_divide(price - mean, regular), mean, "local"))
    )


def anomaly_trigger(
    z: Column, mean: Column, price: Column, sticker_count: Column, tuning: Tuning = DEFAULTS
) -> Column:
    """Strictly below the threshold; without stickers also a minimum absolute saving."""
    stickered = sticker_count > 0
    limit = F.when(stickered, F.lit(tuning.z_sticker_threshold)).otherwise(F.lit(tuning.z_threshold))
    hit = (z < limit) & (stickered | ((mean - price) >= tuning.min_savings_cents))
    return F.coalesce(hit, F.lit(False))


def opportunity(
    price: Column,
    has_baseline: Column,
    support_floor: Column,
    latest: Column,
    rolling_30d: Column,
    volatility: Column,
    sticker_value: Column,
) -> Column:
    """Struct (approved, reason): floor, two-sigma and sticker-premium rules in this order."""
    value = F.coalesce(sticker_value, F.lit(0))
    premium = price - F.coalesce(latest, F.lit(0))
    sigmas = F.when(volatility > 0, F.try_divide((rolling_30d - price).cast("double"), volatility.cast("double")))
    percent = F.try_divide(premium.cast("double"), value.cast("double")) * F.lit(100)
    reason = (
        F.when(~has_baseline, F.lit("no_baseline"))
        .when(price <= F.coalesce(support_floor, F.lit(0)), F.lit("support_floor"))
        .when(sigmas >= SIGMA_LIMIT, F.lit("two_sigma"))
        .when((value > STICKER_VALUE_LIMIT) & (premium <= 0), F.lit("free_stickers"))
        .when((value > STICKER_VALUE_LIMIT) & (percent <= STICKER_PREMIUM_PERCENT), F.lit("sticker_premium"))
        .otherwise(F.lit("no_edge"))
    )
    return F.struct((~reason.isin("no_baseline", "no_edge")).alias("approved"), reason.alias("reason"))


def estimated_profit(latest: Column, price: Column) -> Column:
    return F.coalesce(latest, price) - price
