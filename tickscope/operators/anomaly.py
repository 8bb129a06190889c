"""Scoring of deduplicated ticks: window moments, macro prior, trigger, rules, trades."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.functions.scoring import (
    DEFAULTS, Tuning, anomaly_trigger, estimated_profit, opportunity, z_score,
)
from tickscope.operators.dedup import accepted_windows
from tickscope.operators.ingest import upsert_items
from tickscope.operators.joins import lookup
from tickscope.operators.ordering import GROUP_ROWS
from tickscope.session import stored

BASELINE_COLUMNS = [
    "support_floor_cents", "latest_price_cents", "rolling_30d_avg_cents", "volatility_cents",
    "drift_percent", "cv_published",
]


def with_baseline(ticks: DataFrame, baselines: DataFrame) -> DataFrame:
    """Left lookup of the published baseline; ``has_baseline`` tells whether there was one."""
    table = baselines.select("market_hash_name", *BASELINE_COLUMNS, F.lit(True).alias("_found"))
    joined = lookup(ticks, table, "market_hash_name")
    return joined.withColumn("has_baseline", F.coalesce("_found", F.lit(False))).drop("_found")


def with_score(windowed: DataFrame, tuning: Tuning = DEFAULTS, price: str = "price_cents") -> DataFrame:
    """Add the ``score`` struct; ``price`` is the newest price of the window."""
    return windowed.withColumn(
        "score",
        z_score(F.col(price), F.col("n"), F.col("sx"), F.col("sxx"), F.col("rolling_30d_avg_cents"),
                F.col("volatility_cents"), F.col("cv_published"), tuning),
    )


def sticker_value(ticks: DataFrame, sticker_prices: DataFrame) -> DataFrame:
    """(id, sticker_value_cents) of ticks with stickers; unknown or non-numeric prices are 0."""
    names = (
        ticks.filter(F.size("stickers") > 0)
        .select("id", F.explode("stickers.name").alias("name"))
        .withColumn("name", F.nullif("name", F.lit("")))
    )
    priced = lookup(names, sticker_prices.select("name", F.col("price").try_cast("bigint").alias("_price")), "name")
    return priced.groupBy("id").agg(F.coalesce(F.sum("_price"), F.lit(0)).alias("sticker_value_cents"))


def judge(scored: DataFrame, sticker_prices: DataFrame, tuning: Tuning = DEFAULTS) -> DataFrame:
    """Decision per triggered tick. Stickers are only priced for ticks that triggered."""
    count = F.coalesce(F.size("stickers"), F.lit(0))
    # few rows, used twice
    hits = stored(scored.filter(
        anomaly_trigger(F.col("score.z"), F.col("score.mean"), F.col("price_cents"), count, tuning)
    ))
    valued = hits.join(sticker_value(hits, sticker_prices), "id", "left").withColumn(
        "sticker_value_cents", F.coalesce("sticker_value_cents", F.lit(0))
    )
    rule = opportunity(
        F.col("price_cents"), F.col("has_baseline"), F.col("support_floor_cents"), F.col("latest_price_cents"),
        F.col("rolling_30d_avg_cents"), F.col("volatility_cents"), F.col("sticker_value_cents"),
    )
    return valued.withColumn("rule", rule).select(
        "id", "market_hash_name", "timestamp", "price_cents", "float_value",
        F.col("score.z").alias("z_score"), F.col("score.mean").alias("mean_cents"),
        F.col("score.source").alias("source"), F.size("stickers").cast("bigint").alias("sticker_count"),
        "sticker_value_cents", F.col("rule.approved").alias("approved"), F.col("rule.reason").alias("reason"),
        estimated_profit(F.col("latest_price_cents"), F.col("price_cents")).alias("estimated_profit_cents"),
    )


def detect_anomalies(
    ticks: DataFrame, baselines: DataFrame, sticker_prices: DataFrame,
    tuning: Tuning = DEFAULTS, limit: int = GROUP_ROWS,
) -> DataFrame:
    """Batch form of the hot path: one decision row per anomaly in ``ticks``."""
    windowed = accepted_windows(ticks, tuning.dedup_window_s, tuning.window_size, limit)
    return judge(with_score(with_baseline(windowed, baselines), tuning), sticker_prices, tuning)


class TradeLog(NamedTuple):
    trades: DataFrame
    items: DataFrame


def append_trades(decisions: DataFrame, items: DataFrame) -> TradeLog:
    """Trade rows of the approved decisions, and the items with those that the trades name for the first
    time; z is kept to 4 decimals as the trade log does."""
    approved = decisions.filter("approved")
    items_after = stored(upsert_items(approved, items))
    table = items_after.select("market_hash_name", F.col("id").alias("item_id"))
    trades = lookup(approved, table, "market_hash_name", "inner").select(
        F.col("id").cast("string").alias("id"), "item_id",
        F.col("price_cents").alias("purchase_price_cents"), "estimated_profit_cents",
        F.bround("z_score", 4).alias("trigger_z_score"),
        F.timestamp_seconds("timestamp").alias("simulated_buy_timestamp"),
    )
    return TradeLog(trades, items_after)
