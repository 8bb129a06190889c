"""Wear floats: tier and quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier boundaries [low, high).
TIERS = [
    (0.00, 0.07, "Factory New"),
    (0.07, 0.15, "Minimal Wear"),
    (0.15, 0.38, "Field-Tested"),
    (0.38, 0.45, "Well-Worn"),
    (0.45, 1.01, "Battle-Scarred"),
]

# Quality below an upper bound, first match wins.
QUALITY_BELOW = [
    (0.01, "Exceptional", 1.5, "Top percentile float — significant premium over standard FN."),
    (0.03, "Excellent", 1.3, "Excellent low float — clean appearance commands noticeable premium."),
    (0.07, "Good", 1.1, "Good Factory New float — above average but not exceptional."),
    (0.08, "Good", 1.15, "FN-look Minimal Wear — visually indistinguishable from Factory New, mild premium."),
    (0.10, "Decent", 1.05, "Low float Minimal Wear — cleaner than average, small premium."),
    (0.16, "Good", 1.1, "Low float Field-Tested — close to Minimal Wear appearance, mild premium."),
    (0.20, "Decent", 1.03, "Lower-end Field-Tested — slightly cleaner than typical FT."),
]
# Quality from a lower bound, first match wins.
QUALITY_FROM = [
    (0.95, "Exceptional", 1.3, "Extreme high float — potential collector value for certain patterns."),
    (0.90, "Notable", 1.15, "High float Battle-Scarred — may carry a niche premium for specific items."),
]
# Quality of a float in no band, and of one outside 0 to 1.
STANDARD = ("Standard", 1.0, "Standard float — falls in typical wear corridor, no extra premium.")
INVALID = ("Standard", 1.0, "Invalid float value.")


def wear_tier(value: Column) -> Column:
    tier = F.when(value.isNull(), F.lit(None).cast("string"))
    for low, high, label in TIERS:
        tier = tier.when((value >= low) & (value < high), F.lit(label))
    return tier.otherwise(F.lit("Unknown"))


def _quality(row: tuple[str, float, str]) -> Column:
    name, multiplier, text = row
    return F.struct(
        F.lit(name).alias("quality"), F.lit(multiplier).alias("multiplier"), F.lit(text).alias("description")
    )


def float_quality(value: Column) -> Column:
    """Struct (quality, multiplier, description); null for a null float."""
    ladder = F.when(value.isNull(), F.lit(None)).when((value < 0.0) | (value > 1.0), _quality(INVALID))
    for bound, *row in QUALITY_BELOW:
        ladder = ladder.when(value < bound, _quality(tuple(row)))
    for bound, *row in QUALITY_FROM:
        ladder = ladder.when(value >= bound, _quality(tuple(row)))
    return ladder.otherwise(_quality(STANDARD))
