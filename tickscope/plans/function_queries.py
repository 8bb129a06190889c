"""All SQL functions, wear descriptions and the stored tables in one comparison each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.functions import wear
from tickscope.functions.sql import register_functions
from tickscope.operators import baselines as B
from tickscope.plans.item_queries import macro_sql, ntz
from tickscope.plans.registry import Views, query
from tickscope.plans.tick_queries import MULTIPLIER, QUALITY, TIERS
from tickscope.session import ensure_checkpoint_dir
from tickscope.sources.tables import append_table, read_table, write_snapshot

# Description of each band of the float.
DESCRIPTION = """CASE WHEN f < 0 OR f > 1 THEN 'Invalid float value.'
    WHEN f < 0.01 THEN 'Top percentile float — significant premium over standard FN.'
    WHEN f < 0.03 THEN 'Excellent low float — clean appearance commands noticeable premium.'
    WHEN f < 0.07 THEN 'Good Factory New float — above average but not exceptional.'
    WHEN f < 0.08 THEN 'FN-look Minimal Wear — visually indistinguishable from Factory New, mild premium.'
    WHEN f < 0.10 THEN 'Low float Minimal Wear — cleaner than average, small premium.'
    WHEN f < 0.16 THEN 'Low float Field-Tested — close to Minimal Wear appearance, mild premium.'
    WHEN f < 0.20 THEN 'Lower-end Field-Tested — slightly cleaner than typical FT.'
    WHEN f >= 0.95 THEN 'Extreme high float — potential collector value for certain patterns.'
    WHEN f >= 0.90 THEN 'High float Battle-Scarred — may carry a niche premium for specific items.'
    ELSE 'Standard float — falls in typical wear corridor, no extra premium.' END"""


@query("wear_descriptions", f"""
    SELECT id, {QUALITY} AS quality, {MULTIPLIER} AS multiplier, {DESCRIPTION} AS description
    FROM (SELECT id, float_value * CAST(1.1 AS DOUBLE) - CAST(0.02 AS DOUBLE) AS f FROM fx_ticks)""")
def wear_descriptions(v: Views) -> DataFrame:
    value = F.col("float_value") * F.lit(1.1) - F.lit(0.02)  # values outside 0 to 1 occur
    return v.ticks.select("id", wear.float_quality(value).alias("q")).select("id", "q.*")


# Arguments of the functions, in SQL that both engines read alike.
ARGUMENTS = """
    SELECT t.id, t.k, t.price_cents AS p, t.timestamp AS sec, t.float_value AS f, p.market_hash_name AS name, p.base_name,
           p.phase, p.item_type, replace(replace(p.market_hash_name, ' ', '%20'), '|', '%7C') || '.csv' AS raw,
           CAST(t.k AS DOUBLE) AS x, CAST(t.k % 7 AS BIGINT) AS n, t.price_cents + t.k * 10 AS macro_avg, t.k * 3 AS macro_vol,
           CASE WHEN t.k % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(t.k AS DOUBLE) / 100 END AS cv,
           t.k AS d, t.k + 1 - t.k % 4 AS w, t.k + 5 - 3 * (t.k % 3) AS m,
           CASE WHEN t.k % 8 <> 0 THEN t.price_cents - 900 + t.k * 20 END AS latest
    FROM fx_ticks AS t JOIN fx_parts AS p ON p.part_id = t.item_id"""
WINDOW = "named_struct('median', CAST({0} AS STRING), 'volume', CAST({1} AS BIGINT))"
HISTORY = ("named_struct('version', CAST(NULL AS STRING), 'item_page', '', 'market_page', '', 'last_24_hours', "
           f"{WINDOW.format('d', 'k % 2')}, 'last_7_days', {WINDOW.format('w', 'k % 3')}, 'last_30_days', "
           f"{WINDOW.format('m', 'k % 5')}, 'last_90_days', {WINDOW.format('k + 3', '0')})")


@query("sql_functions_all", f"""
    WITH arguments AS ({ARGUMENTS}),
    moments AS (SELECT *, CASE WHEN n > 0 THEN n * p + k ELSE 0 END AS total,
                       CASE WHEN n > 0 THEN n * p * p + 2 * p * k + k * k ELSE 0 END AS squares FROM arguments),
    spread AS (SELECT *, CAST(total AS DOUBLE) / nullif(CAST(n AS DOUBLE), 0) AS mean, macro_vol > 0 AND macro_avg > 0 AS usable,
                      coalesce(CAST(n * squares - total * total AS DOUBLE) / nullif(CAST(n * (n - 1) AS DOUBLE), 0), 0) AS variance
               FROM moments),
    sources AS (SELECT *, CASE WHEN n < 3 AND usable THEN 'macro' WHEN n < 3 THEN NULL WHEN usable AND cv > 0 THEN 'hybrid'
                               ELSE 'local' END AS z_source FROM spread),
    drops AS (SELECT *, CASE WHEN w < m THEN CAST(m - w AS DOUBLE) / m END AS medium,
                     CASE WHEN d <> 0 AND d < w THEN CAST(w - d AS DOUBLE) / w END AS short FROM sources)
    SELECT id, name AS item_name, item_type, base_name, phase AS version, name AS versioned_name,
           CAST(round_even(x / 800 * 100, 0) AS BIGINT) AS to_cents, make_timestamp(sec * 1000000) AS epoch_to_ts,
           CAST(CASE WHEN k % 2 > 0 THEN d WHEN k % 3 > 0 THEN w WHEN k % 5 > 0 THEN m ELSE k + 3 END AS DOUBLE) AS recent_median,
           medium IS NOT NULL OR short IS NOT NULL AS falling,
           coalesce(medium, CAST(0 AS DOUBLE)) + coalesce(short, CAST(0 AS DOUBLE)) AS severity,
           CAST(CASE WHEN item_type IN ('Knife', 'Glove') THEN 0.25 WHEN item_type IN ('Sticker', 'Patch') THEN 0.35
                     ELSE 0.30 END AS DOUBLE) AS discount_corridor,
           NOT (k % 2 = 0 AND x / 100 < CASE WHEN k * 300 > 15000 OR item_type IN ('Knife', 'Glove') THEN CAST(0.05 AS DOUBLE)
                                             ELSE CAST(0.5 AS DOUBLE) END) AS is_liquid,
           abs(x * 10 * (1 - CAST(0.3 AS DOUBLE)) - (500 - x)) / (500 - x) > CAST(0.35 AS DOUBLE) AS regime_shift,
           CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 3 = 0 THEN k * 7 WHEN k % 2 <> 0
                  THEN CAST(round_even((x * 10 + 2) * CAST(0.75 AS DOUBLE), 0) AS BIGINT)
                  ELSE CAST(round_even(x + CAST(0.5 AS DOUBLE), 0) AS BIGINT) END END AS cash_equivalent,
           CAST(round_even(p * (CAST(0.85 AS DOUBLE) - CASE WHEN k % 2 = 0 THEN least(CAST(0.15 AS DOUBLE), x / 200)
             ELSE CAST(0 AS DOUBLE) END), 0) AS BIGINT) AS snipe_threshold,
           {TIERS} AS wear_tier, {QUALITY} AS quality, {MULTIPLIER} AS multiplier, {DESCRIPTION} AS description,
           CASE z_source WHEN 'macro' THEN (p - macro_avg) / nullif(greatest(CAST(macro_vol AS DOUBLE),
                                                                             macro_avg * CAST(0.01 AS DOUBLE)), 0)
             WHEN 'hybrid' THEN (p - mean) / nullif(sqrt((n * variance + CAST(5 AS DOUBLE) * (mean * cv * (mean * cv)))
                                                         / (n + CAST(5 AS DOUBLE))), 0)
             WHEN 'local' THEN (p - mean) / nullif(greatest(sqrt(variance), mean * CAST(0.04 AS DOUBLE)), 0) END AS z,
           CASE WHEN z_source = 'macro' THEN CAST(macro_avg AS DOUBLE) WHEN z_source IS NOT NULL THEN mean END AS z_mean, z_source,
           CASE WHEN k % 3 > 0 THEN -x / 20 < -1 ELSE -x / 20 < -2 AND k - 20 >= 50 END AS anomaly_trigger,
           CASE WHEN k % 9 = 0 THEN 'no_baseline' WHEN k >= 50 THEN 'support_floor' WHEN k % 5 IN (1, 2) THEN 'two_sigma'
                WHEN k * 250 > 10000 AND p - coalesce(latest, 0) <= 0 THEN 'free_stickers'
                WHEN k * 250 > 10000 AND CAST(p - coalesce(latest, 0) AS DOUBLE) / (k * 250) * 100 <= 3 THEN 'sticker_premium'
                ELSE 'no_edge' END AS reason,
           NOT (k % 9 = 0 OR NOT (k >= 50 OR k % 5 IN (1, 2) OR (k * 250 > 10000 AND (p - coalesce(latest, 0) <= 0
                OR CAST(p - coalesce(latest, 0) AS DOUBLE) / (k * 250) * 100 <= 3)))) AS approved,
           coalesce(latest, p) - p AS estimated_profit,
           CAST(coalesce(nullif(k % 2, 0), nullif(k % 3, 0), nullif(k % 5, 0), 0) AS BIGINT) AS live_floor,
           CASE WHEN k % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS liquidity_label, replace(name, '★', '') AS ascii_only,
           CASE WHEN k * 2 - 10 < 0 OR k * 2 - 10 > 100 THEN 'ERROR' WHEN k * 2 - 10 >= 70 THEN 'APPROVED' ELSE 'REJECTED' END
             AS verdict
    FROM drops""")
def sql_functions_all(v: Views) -> DataFrame:
    """Each registered function called from SQL."""
    register_functions(v.spark)
    parts, ticks = v.parts, v.ticks
    text = ARGUMENTS.replace("fx_ticks", "{ticks}").replace("fx_parts", "{parts}")
    arguments = v.spark.sql(text, ticks=ticks, parts=parts)
    return ntz(v.spark.sql(f"""
        SELECT id, item_name, item_type, base_name, version, versioned_name, to_cents, epoch_to_ts, recent_median,
               falling.detected AS falling, falling.severity AS severity, discount_corridor, is_liquid, regime_shift,
               cash_equivalent, snipe_threshold, wear_tier, graded.quality AS quality, graded.multiplier AS multiplier,
               graded.description AS description, scored.z AS z, scored.mean AS z_mean, scored.source AS z_source,
               anomaly_trigger, ruled.reason AS reason, ruled.approved AS approved, estimated_profit, live_floor,
               liquidity_label, ascii_only, verdict
        FROM (SELECT id, ts_item_name(raw) AS item_name, ts_item_type(name) AS item_type, ts_base_name(name) AS base_name,
                     ts_version(name) AS version, ts_versioned_name(base_name, phase) AS versioned_name,
                     ts_to_cents(x / 800) AS to_cents, ts_epoch_to_ts(sec) AS epoch_to_ts,
                     ts_recent_median(history) AS recent_median, ts_downtrend(history) AS falling,
                     ts_discount_corridor(item_type) AS discount_corridor,
                     ts_is_liquid(k % 2 = 0, k * 300, x / 100, item_type) AS is_liquid,
                     ts_regime_shift(x * 10, 500 - x, 0.3D) AS regime_shift,
                     ts_cash_equivalent(k % 4 <> 0, CASE WHEN k % 3 = 0 THEN k * 7 END, x * 10 + 2, x + 0.5D, k % 2 = 0, 0.25D)
                       AS cash_equivalent,
                     ts_snipe_threshold(p, k % 2 = 0, x / 200) AS snipe_threshold, ts_wear_tier(f) AS wear_tier,
                     ts_float_quality(f) AS graded,
                     ts_z_score(p, n, CASE WHEN n > 0 THEN n * p + k ELSE 0 END,
                                CASE WHEN n > 0 THEN n * p * p + 2 * p * k + k * k ELSE 0 END, macro_avg, macro_vol, cv) AS scored,
                     ts_anomaly_trigger(-x / 20, CAST(p + k - 20 AS DOUBLE), p, CAST(k % 3 AS INT)) AS anomaly_trigger,
                     ts_opportunity(p, k % 9 <> 0, p - 50 + k, latest, p + 100, k % 5 * 20 + CASE WHEN k % 5 > 2 THEN 100 ELSE 0 END,
                                    k * 250) AS ruled,
                     ts_estimated_profit(latest, p) AS estimated_profit, ts_live_floor(k % 2, k % 3, k % 5) AS live_floor,
                     ts_liquidity_label(k % 2 = 0) AS liquidity_label, ts_ascii_only(name) AS ascii_only,
                     ts_verdict(k * 2 - 10) AS verdict
              FROM (SELECT *, {HISTORY} AS history FROM {{arguments}}))""", arguments=arguments), "epoch_to_ts")


@query("stored_tables", f"""
    WITH {macro_sql("fx_sales", "id")}
    SELECT 'market_items' AS stored, CAST(id AS STRING) AS key, market_hash_name || ':' || item_type AS row FROM fx_items
    UNION ALL SELECT 'live_market_ticks', CAST(id AS STRING), item_id || ':' || price_cents || ':' || marketplace_source
      || ':' || epoch_us(inserted_at) FROM fx_ticks
    UNION ALL SELECT 'simulated_trades', id, item_id || ':' || purchase_price_cents || ':' || estimated_profit_cents
      || ':' || epoch_us(simulated_buy_timestamp) FROM fx_trades
    UNION ALL SELECT 'item_macro_baselines', CAST(item_id AS STRING), latest_price_cents || ':' || rolling_30d_avg_cents
      || ':' || rolling_90d_avg_cents || ':' || volatility_cents || ':' || support_floor_cents FROM macro
    UNION ALL SELECT 'ingestion_batches', marketplace_source, count(*) || ':' || epoch_us(max(inserted_at)) FROM fx_ticks
      GROUP BY marketplace_source
    UNION ALL SELECT 'sticker_prices', name, price FROM fx_sticker_prices""")
def stored_tables(v: Views) -> DataFrame:
    """Tables written with their schemas, as snapshots or appended to, and read back."""
    ensure_checkpoint_dir(v.spark)
    root = f"{v.spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    none = lambda kind: F.lit(None).cast(kind)
    # a first snapshot that the second one replaces
    write_snapshot(v.items.filter("item_type = 'Knife'"), root, "market_items")
    write_snapshot(v.items, root, "market_items")
    ticks = v.ticks.withColumn("paint_index", none("int"))
    trades = v.trades
    for even in (True, False):
        append_table(ticks.filter((F.col("k") % 2 == 0) == even), root, "live_market_ticks")
        append_table(trades.filter((F.col("item_id") % 2 == 0) == even), root, "simulated_trades")
    macro = B.macro_baselines(v.sales, ["id"])
    missing = [f for f in v.spark.createDataFrame([], schemas.ITEM_MACRO_BASELINES).schema if f.name not in macro.columns]
    write_snapshot(macro.select("*", *[none(f.dataType).alias(f.name) for f in missing]), root, "item_macro_baselines")
    batches = v.ticks.groupBy(F.col("marketplace_source").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("record_count"), F.max("inserted_at").alias("received_at"))
    append_table(batches.select("*", F.col("batch_id").alias("source"), none("string").alias("payload_sha256")),
                 root, "ingestion_batches")
    write_snapshot(v.sticker_prices, root, "sticker_prices")

    def rows(table: str, key: str, *values: str) -> DataFrame:
        table_rows = read_table(v.spark, root, table)
        kinds = dict(table_rows.dtypes)
        cells = [(F.unix_micros(c) if kinds[c] == "timestamp" else F.col(c)).cast("string") for c in values]
        joined = [part for c in cells for part in (F.lit(":"), c)][1:]
        return table_rows.select(F.lit(table).alias("stored"), F.col(key).cast("string").alias("key"), F.concat(*joined).alias("row"))

    found = [
        rows("market_items", "id", "market_hash_name", "item_type"),
        rows("live_market_ticks", "id", "item_id", "price_cents", "marketplace_source", "inserted_at"),
        rows("simulated_trades", "id", "item_id", "purchase_price_cents", "estimated_profit_cents", "simulated_buy_timestamp"),
        rows("item_macro_baselines", "item_id", "latest_price_cents", "rolling_30d_avg_cents", "rolling_90d_avg_cents",
             "volatility_cents", "support_floor_cents"),
        rows("ingestion_batches", "batch_id", "record_count", "received_at"),
        rows("sticker_prices", "name", "price"),
    ]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole
