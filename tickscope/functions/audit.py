"""Trade-audit expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: score from which a trade is approved.
APPROVAL_SCORE = 70


def live_floor(cash: Column, median: Column, threshold: Column) -> Column:
    """First non-zero of the three prices, else 0."""
    zero = F.lit(0)
    return F.coalesce(F.nullif(cash, zero), F.nullif(median, zero), F.nullif(threshold, zero), zero)


def liquidity_label(liquid: Column) -> Column:
    return F.when(liquid, F.lit("HIGH")).otherwise(F.lit("LOW"))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "")


def verdict(score: Column) -> Column:
    """ERROR without a score from 0 to 100."""
    return (
        F.when(score.isNull() | (score < 0) | (score > 100), F.lit("ERROR"))
        .when(score >= APPROVAL_SCORE, F.lit("APPROVED"))
        .otherwise(F.lit("REJECTED"))
    )
