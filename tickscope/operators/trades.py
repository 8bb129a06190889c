"""Trade audit: trades with their item, latest wear and market context, and their verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.functions.audit import ascii_only, live_floor, liquidity_label, verdict
from tickscope.functions.wear import float_quality, wear_tier
from tickscope.operators.joins import lookup


def trade_items(trades: DataFrame, items: DataFrame) -> DataFrame:
    """Trades with their item name."""
    return lookup(trades, items.select(F.col("id").alias("item_id"), "market_hash_name"), "item_id", "inner")


def latest_tick(ticks: DataFrame, source: str | None = None) -> DataFrame:
    """Wear of the newest tick per item, null when that tick has none."""
    chosen = ticks if source is None else ticks.filter(F.col("marketplace_source") == source)
    newest = F.max_by(F.struct("float_value"), F.struct("inserted_at", "id"))
    return chosen.groupBy("item_id").agg(newest.alias("_t")).select("item_id", F.col("_t.float_value").alias("float_value"))


def trades_with_wear(trades: DataFrame, items: DataFrame, ticks: DataFrame) -> DataFrame:
    # one row per item on the right: a plain join, whose skewed partitions Spark splits at run time
    return trade_items(trades, items).join(latest_tick(ticks), "item_id", "left")


def audit_features(trades: DataFrame, items: DataFrame, ticks: DataFrame, context: DataFrame) -> DataFrame:
    """Everything an auditor looks at, one row per trade."""
    prices = context.select(
        "market_hash_name", F.lit(True).alias("_known"), "is_liquid",
        live_floor(F.col("cash_equivalent_avg_cents"), F.col("real_time_skinport_median_cents"),
                   F.col("snipe_threshold_cents")).alias("live_floor_cents"),
        F.coalesce("real_time_skinport_median_cents", F.lit(0)).alias("recent_sale_cents"),
    )
    rows = trades_with_wear(trades, items, ticks).join(prices, "market_hash_name", "left")
    quality = float_quality(F.col("float_value"))
    paid, floor = F.col("purchase_price_cents"), F.col("live_floor_cents")
    return rows.withColumn("_q", quality).select(
        "id", "item_id", "market_hash_name", "purchase_price_cents", "estimated_profit_cents", "trigger_z_score",
        "float_value", wear_tier(F.col("float_value")).alias("wear_tier"), F.col("_q.quality").alias("float_quality"),
        F.col("_q.multiplier").alias("premium_multiplier"), F.col("_q.description").alias("description"),
        "live_floor_cents", "recent_sale_cents",
        F.when(F.col("_known"), liquidity_label(F.col("is_liquid"))).otherwise(F.lit("UNKNOWN")).alias("liquidity"),
        (floor - paid).alias("below_floor_cents"),
    )


def apply_verdicts(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Verdict per trade from an external table (id, score, reasoning); missing scores are errors."""
    rated = lookup(features, scores.select("id", "score", "reasoning"), "id", derived=True)
    failed = verdict(F.col("score")) == "ERROR"
    return rated.select(
        *features.columns,
        F.when(failed, F.lit(0)).otherwise(F.col("score")).cast("bigint").alias("confidence_score"),
        ascii_only(F.coalesce("reasoning", F.lit("no response"))).alias("reasoning"),
        verdict(F.col("score")).alias("verdict"),
    )
