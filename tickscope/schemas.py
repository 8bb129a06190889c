"""Table and message schemas. Money is integer cents, timestamps are UTC."""

from __future__ import annotations

MARKET_ITEMS = "id BIGINT, market_hash_name STRING, item_type STRING, rarity STRING"
LIVE_MARKET_TICKS = (
    "id BIGINT, item_id BIGINT, price_cents BIGINT, marketplace_source STRING, "
    "float_value DOUBLE, paint_index INT, inserted_at TIMESTAMP"
)
HISTORICAL_PRICES = (
    "item_id BIGINT, sale_date TIMESTAMP, median_price_cents BIGINT, volume_sold BIGINT"
)
ITEM_MACRO_BASELINES = (
    "item_id BIGINT, latest_price_cents BIGINT, rolling_30d_avg_cents BIGINT, "
    "rolling_90d_avg_cents BIGINT, drift_percent DOUBLE, volatility_cents BIGINT, "
    "avg_volume_30d DOUBLE, support_floor_cents BIGINT, updated_at TIMESTAMP"
)
SIMULATED_TRADES = (
    "id STRING, item_id BIGINT, purchase_price_cents BIGINT, estimated_profit_cents BIGINT, "
    "trigger_z_score DOUBLE, simulated_buy_timestamp TIMESTAMP"
)
INGESTION_BATCHES = (
    "batch_id STRING, source STRING, record_count BIGINT, payload_sha256 STRING, "
    "received_at TIMESTAMP"
)
# Lookups of the hot path, keyed by name.
PUBLISHED_BASELINES = (
    "market_hash_name STRING, support_floor_cents BIGINT, latest_price_cents BIGINT, "
    "rolling_30d_avg_cents BIGINT, volatility_cents BIGINT, drift_percent DOUBLE, cv_published DOUBLE, "
    "payload_json STRING"
)
STICKER_PRICES = "name STRING, price STRING"

TABLES = {
    "market_items": MARKET_ITEMS,
    "live_market_ticks": LIVE_MARKET_TICKS,
    "historical_prices": HISTORICAL_PRICES,
    "item_macro_baselines": ITEM_MACRO_BASELINES,
    "simulated_trades": SIMULATED_TRADES,
    "ingestion_batches": INGESTION_BATCHES,
    "published_baselines": PUBLISHED_BASELINES,
    "sticker_prices": STICKER_PRICES,
}

STICKERS = "ARRAY<STRUCT<name: STRING>>"

# Raw history files carry text only; numbers are cast after the checks.
HISTORY_CSV = "name STRING, `unix timestamp` STRING, price STRING, quantity STRING"
HISTORY_COLUMNS = ["name", "unix timestamp", "price", "quantity"]

BATCH_TICKS = "ARRAY<STRUCT<market_hash_name: STRING, price_cents: BIGINT, timestamp: BIGINT>>"

# Medians stay text: a malformed one must read as missing, not fail the record.
SALES_WINDOW = "STRUCT<median: STRING, volume: BIGINT>"
SALES_HISTORY = (
    f"STRUCT<version: STRING, item_page: STRING, market_page: STRING, "
    f"last_24_hours: {SALES_WINDOW}, last_7_days: {SALES_WINDOW}, "
    f"last_30_days: {SALES_WINDOW}, last_90_days: {SALES_WINDOW}>"
)

LISTING_MESSAGE = (
    "STRUCT<eventType: STRING, sales: ARRAY<STRUCT<marketHashName: STRING, salePrice: DOUBLE, "
    f"wear: DOUBLE, stickers: {STICKERS}, version: STRING>>>"
)
SNAPSHOT_ENTRY = "market_hash_name STRING, min_price DOUBLE, version STRING"
