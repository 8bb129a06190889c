"""Queries over trades and market context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.functions.audit import ascii_only as strip_non_ascii
from tickscope.functions.sql import register_functions
from tickscope.operators import baselines as B
from tickscope.operators import context as C
from tickscope.operators import monitoring as M
from tickscope.operators import trades as T
from tickscope.plans.item_queries import macro_sql, ntz
from tickscope.plans.registry import Views, query
from tickscope.plans.tick_queries import MULTIPLIER, QUALITY, TIERS

LIVE = "purchase"


def sales_entries(v: Views) -> DataFrame:
    """Sales-history entries (base_name, pos, entry) as an API would deliver them."""
    def window(suffix: str) -> Column:
        return F.struct(F.col(f"m{suffix}").cast("string").alias("median"), F.col(f"v{suffix}").alias("volume"))

    entry = F.struct(
        F.col("phase").alias("version"),
        F.concat(F.lit("/item/"), "base_name").alias("item_page"),
        F.concat(F.lit("/market/"), "base_name").alias("market_page"),
        window("1").alias("last_24_hours"), window("7").alias("last_7_days"),
        window("30").alias("last_30_days"), window("90").alias("last_90_days"),
    )
    return v.sales_windows.select("base_name", F.lit(0).alias("pos"), entry.cast(schemas.SALES_HISTORY).alias("entry"))


def live_history(v: Views) -> DataFrame:
    """Price history on the base items, at the price level of the ticks."""
    return v.ticks.filter(F.col("price_cents") > 0).select(
        "item_id", F.col("inserted_at").alias("sale_date"), F.col("price_cents").alias("median_price_cents"),
        F.lit(1).cast("bigint").alias("volume_sold"), "id",
    )


def context(v: Views) -> DataFrame:
    return C.market_context(
        v.parts.select("market_hash_name"), v.items, live_history(v), v.named_ticks,
        B.macro_baselines(v.sales, ["id"]), sales_entries(v), LIVE,
    )


CONTEXT = f"""
      {macro_sql("fx_sales", "id")},
      steam AS (SELECT item_id, avg(price_cents) AS avg_steam FROM fx_ticks WHERE price_cents > 0 GROUP BY item_id),
      live AS (SELECT item_id, avg(price_cents) AS avg_source FROM fx_named_ticks
               WHERE marketplace_source = '{LIVE}' GROUP BY item_id),
      wide AS (
        SELECT p.market_hash_name, p.item_type, p.base_name, avg_steam, avg_source, m.item_id IS NOT NULL AS has_macro,
               m.*, s.base_name IS NOT NULL AS has_sales, nullif(m1, 0) AS m1, v1, nullif(m7, 0) AS m7, v7,
               nullif(m30, 0) AS m30, v30, nullif(m90, 0) AS m90,
               CAST(CASE WHEN p.item_type IN ('Knife', 'Glove') THEN 0.25 WHEN p.item_type IN ('Sticker', 'Patch')
                    THEN 0.35 ELSE 0.30 END AS DOUBLE) AS discount
        FROM fx_parts AS p
        LEFT JOIN steam ON steam.item_id = p.part_id
        LEFT JOIN live ON live.item_id = p.live_id
        LEFT JOIN macro AS m ON m.item_id = p.live_id
        LEFT JOIN fx_sales_windows AS s ON s.base_name = p.base_name AND s.phase IS NOT DISTINCT FROM p.phase),
      trend AS (
        SELECT *, CAST(round_even(coalesce(CASE WHEN v1 > 0 THEN m1 END, CASE WHEN v7 > 0 THEN m7 END,
                   CASE WHEN v30 > 0 THEN m30 END, m90) * 100, 0) AS BIGINT) AS median_cents,
               CASE WHEN coalesce(m7, m1) < coalesce(m30, m90)
                 THEN (coalesce(m30, m90) - coalesce(m7, m1)) / coalesce(m30, m90) END AS medium,
               CASE WHEN m1 < m7 THEN (m7 - m1) / m7 END AS short,
               NOT (has_macro AND coalesce(avg_volume_30d < CASE WHEN latest_price_cents > 15000
                 OR item_type IN ('Knife', 'Glove') THEN 0.05 ELSE 0.5 END, false)) AS is_liquid
        FROM wide),
      shifted AS (
        SELECT *, coalesce(medium, 0.0) + coalesce(short, 0.0) AS severity,
               medium IS NOT NULL OR short IS NOT NULL AS falling,
               coalesce(CASE WHEN coalesce(CAST(median_cents AS DOUBLE), avg_source) > 0
                 THEN abs(avg_steam * (1.0 - discount) - coalesce(CAST(median_cents AS DOUBLE), avg_source))
                      / coalesce(CAST(median_cents AS DOUBLE), avg_source) ELSE 0 END > 0.35, false) AS shift
        FROM trend),
      cashed AS (
        SELECT *, CASE WHEN is_liquid THEN coalesce(median_cents,
                 CASE WHEN NOT shift THEN CAST(round_even(avg_steam * (1.0 - discount), 0) AS BIGINT) END,
                 CAST(round_even(avg_source, 0) AS BIGINT)) END AS cash FROM shifted),
      context AS (
        SELECT market_hash_name, CAST(round_even(avg_steam, 0) AS BIGINT) AS historical_steam_avg_cents,
               CAST(round_even(avg_source, 0) AS BIGINT) AS historical_skinport_avg_cents,
               median_cents AS real_time_skinport_median_cents, cash AS cash_equivalent_avg_cents,
               CAST(round_even(cash * (CAST(0.85 AS DOUBLE) - CASE WHEN falling THEN least(CAST(0.15 AS DOUBLE), severity)
                 ELSE CAST(0 AS DOUBLE) END), 0) AS BIGINT) AS snipe_threshold_cents,
               item_type, is_liquid, avg_volume_30d, coalesce(drift_percent, 0.0) AS drift_percent,
               coalesce(volatility_cents, 0) AS volatility_cents, support_floor_cents, shift AS regime_shift_detected,
               falling AS downtrend_detected, severity AS downtrend_severity,
               CASE WHEN has_sales THEN '/item/' || base_name END AS item_page,
               CASE WHEN has_sales THEN '/market/' || base_name END AS market_page
        FROM cashed)"""


@query("market_context", f"WITH {CONTEXT} SELECT * FROM context")
def market_context(v: Views) -> DataFrame:
    return context(v)


@query("sticker_price", """
    WITH hist AS (SELECT item_id, avg(median_price_cents) AS h FROM fx_history GROUP BY item_id),
    tick AS (SELECT item_id, avg(price_cents) AS t FROM fx_ticks GROUP BY item_id)
    SELECT p.base_name AS name, CAST(round_even(coalesce(
             coalesce(CASE WHEN v1 > 0 THEN nullif(m1, 0) END, CASE WHEN v7 > 0 THEN nullif(m7, 0) END,
                      CASE WHEN v30 > 0 THEN nullif(m30, 0) END, nullif(m90, 0)) * 100, h, t), 0) AS BIGINT) AS price_cents
    FROM fx_parts AS p
    LEFT JOIN fx_sales_windows AS s ON s.base_name = p.base_name
    LEFT JOIN hist ON hist.item_id = p.part_id LEFT JOIN tick ON tick.item_id = p.part_id
    WHERE p.item_type = 'Sticker'""")
def sticker_price(v: Views) -> DataFrame:
    stickers = v.parts.filter("item_type = 'Sticker'").select(F.col("base_name").alias("name"))
    return C.sticker_price(stickers, sales_entries(v), v.items, v.history, v.ticks)


@query("trade_items", """
    SELECT t.id, t.item_id, i.market_hash_name, t.purchase_price_cents
    FROM fx_trades AS t JOIN fx_items AS i ON i.id = t.item_id""")
def trade_items(v: Views) -> DataFrame:
    return T.trade_items(v.trades, v.items).select("id", "item_id", "market_hash_name", "purchase_price_cents")


@query("audit_features", f"""
    WITH {CONTEXT},
    wear AS (SELECT item_id, arg_max(float_value, (inserted_at, id)) AS f FROM fx_named_ticks GROUP BY item_id)
    SELECT t.id, t.item_id, i.market_hash_name, purchase_price_cents, estimated_profit_cents, trigger_z_score,
           f AS float_value, {TIERS} AS wear_tier, {QUALITY} AS float_quality, {MULTIPLIER} AS premium_multiplier,
           coalesce(nullif(cash_equivalent_avg_cents, 0), nullif(real_time_skinport_median_cents, 0),
                    nullif(snipe_threshold_cents, 0), 0) AS live_floor_cents,
           coalesce(real_time_skinport_median_cents, 0) AS recent_sale_cents,
           CASE WHEN is_liquid THEN 'HIGH' ELSE 'LOW' END AS liquidity,
           coalesce(nullif(cash_equivalent_avg_cents, 0), nullif(real_time_skinport_median_cents, 0),
                    nullif(snipe_threshold_cents, 0), 0) - purchase_price_cents AS below_floor_cents
    FROM fx_trades AS t JOIN fx_items AS i ON i.id = t.item_id
    JOIN context AS c ON c.market_hash_name = i.market_hash_name JOIN wear AS w ON w.item_id = t.item_id""")
def audit_features(v: Views) -> DataFrame:
    return T.audit_features(v.trades, v.items, v.named_ticks, context(v)).drop("description")


@query("apply_verdicts", """
    WITH scores AS (
      SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text,
             CAST(l.quality * 80 + l.toxic * 30 AS BIGINT) AS score
      FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id)
    SELECT t.id, coalesce(CASE WHEN score BETWEEN 0 AND 100 THEN score END, 0) AS confidence_score,
           regexp_replace(coalesce(text, 'no response'), '[^\\x00-\\x7F]', '', 'g') AS reasoning,
           CASE WHEN score BETWEEN 0 AND 100 THEN CASE WHEN score >= 70 THEN 'APPROVED' ELSE 'REJECTED' END
                ELSE 'ERROR' END AS verdict
    FROM fx_trades AS t LEFT JOIN scores AS s ON s.id = t.id""")
def apply_verdicts(v: Views) -> DataFrame:
    labels = v.table("labels").select("doc_id", (F.col("quality") * 80 + F.col("toxic") * 30).cast("bigint").alias("score"))
    documents = v.table("documents").select("doc_id", F.col("text").alias("reasoning"))
    scores = documents.join(labels, "doc_id", "left").withColumn("id", F.col("doc_id").cast("string"))
    return T.apply_verdicts(v.trades.select("id"), scores)


@query("ascii_only", """
    SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS text FROM documents""")
def ascii_only(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", strip_non_ascii(F.col("text")).alias("text"))


@query("trade_rates", """
    SELECT window_start, count(*) / CAST(5 AS DOUBLE) AS trades_per_min,
           CAST(sum(estimated_profit_cents) AS DOUBLE) / CAST(100 AS DOUBLE) / CAST(5 AS DOUBLE) AS pnl_usd_per_min
    FROM (SELECT estimated_profit_cents, unnest(generate_series(
            time_bucket(INTERVAL 1 MINUTE, simulated_buy_timestamp) - INTERVAL 4 MINUTE,
            time_bucket(INTERVAL 1 MINUTE, simulated_buy_timestamp), INTERVAL 1 MINUTE)) AS window_start FROM fx_trades)
    GROUP BY window_start""")
def trade_rates(v: Views) -> DataFrame:
    return ntz(M.trade_rates(v.trades.withColumnRenamed("simulated_buy_timestamp", "event_time")), "window_start")


@query("pnl_summary", """
    SELECT count(*) AS trades, CAST(sum(estimated_profit_cents) AS BIGINT) AS estimated_profit_cents FROM fx_trades""")
def pnl_summary(v: Views) -> DataFrame:
    return M.pnl_summary(v.trades)


@query("pnl_running", """
    WITH hourly AS (SELECT date_trunc('hour', simulated_buy_timestamp) AS hour, count(*) AS n,
                           sum(estimated_profit_cents) AS p FROM fx_trades GROUP BY ALL)
    SELECT hour, CAST(sum(n) OVER (ORDER BY hour) AS BIGINT) AS running_trades,
           CAST(sum(p) OVER (ORDER BY hour) AS BIGINT) AS running_profit_cents
    FROM hourly""")
def pnl_running(v: Views) -> DataFrame:
    return ntz(M.pnl_running(v.trades.withColumnRenamed("simulated_buy_timestamp", "event_time")), "hour")


@query("sql_functions", f"""
    SELECT id, {TIERS} AS wear_tier, CAST(round_even(price_usd * 100, 0) AS BIGINT) AS cents,
           CASE WHEN k >= 70 THEN 'APPROVED' ELSE 'REJECTED' END AS verdict
    FROM (SELECT *, float_value AS f FROM fx_ticks)""")
def sql_functions(v: Views) -> DataFrame:
    register_functions(v.spark)
    return v.spark.sql(
        "SELECT id, ts_wear_tier(float_value) AS wear_tier, ts_to_cents(price_usd) AS cents, ts_verdict(k) AS verdict "
        "FROM {ticks}", ticks=v.ticks,
    )
