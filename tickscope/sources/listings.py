"""Listing snapshots and listing messages as price ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.functions.names import versioned_name
from tickscope.functions.pricing import to_cents

LISTED = "listed"


def _no_stickers() -> Column:
    return F.array().cast(schemas.STICKERS)


def snapshot_ticks(entries: DataFrame, now: Column) -> DataFrame:
    """Entries (name, USD ``min_price``, version) that carry a price within range, as ticks."""
    return entries.filter(to_cents(F.col("min_price")).isNotNull()).select(
        versioned_name(F.col("market_hash_name"), F.col("version")).alias("market_hash_name"),
        F.col("min_price").cast("double").alias("price_usd"),
        to_cents(F.col("min_price")).alias("price_cents"),
        now.cast("bigint").alias("timestamp"),
        F.lit(None).cast("double").alias("float_value"),
        _no_stickers().alias("stickers"),
    )


def read_listing_snapshot(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Snapshot files: each a JSON list of entries."""
    entries = spark.read.schema(schemas.SNAPSHOT_ENTRY).option("multiLine", True).json(path)
    return snapshot_ticks(entries, now)


def listing_ticks(messages: DataFrame, now: Column, raw_feed: bool = True) -> DataFrame:
    """Ticks from a ``value`` column of JSON listing messages (batch or stream).

    Sales without a name or a price within range are dropped and malformed messages skipped. Prices are cents.
    ``raw_feed`` keeps only messages of the listed event; relayed messages carry no event type.
    """
    parsed = messages.select(F.from_json("value", schemas.LISTING_MESSAGE).alias("m"))
    if raw_feed:
        parsed = parsed.filter(F.col("m.eventType") == LISTED)
    sales = parsed.select(F.explode("m.sales").alias("s"))
    price = F.col("s.salePrice") / F.lit(100.0)
    usable = sales.filter((F.col("s.marketHashName") != "") & to_cents(price).isNotNull())
    return usable.select(
        versioned_name(F.col("s.marketHashName"), F.col("s.version")).alias("market_hash_name"),
        price.alias("price_usd"),
        to_cents(price).alias("price_cents"),
        now.cast("bigint").alias("timestamp"),
        F.col("s.wear").alias("float_value"),
        F.coalesce(F.col("s.stickers"), _no_stickers()).alias("stickers"),
    )


def read_listing_stream(spark: SparkSession, path: str, now: Column, raw_feed: bool = True,
                        files_per_trigger: int | None = None) -> DataFrame:
    """Stream of listing messages, one JSON text per line."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return listing_ticks(reader.load(path), now, raw_feed)
