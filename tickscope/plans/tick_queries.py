"""Queries over ticks: validation, suppression, windows, scores, decisions, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.functions import scoring, wear
from tickscope.operators import anomaly as A
from tickscope.operators import baselines as B
from tickscope.operators import colocated as CO
from tickscope.operators import context as C
from tickscope.operators import monitoring as M
from tickscope.operators.dedup import dedup_ticks as accepted_ticks
from tickscope.operators.dedup import accepted_windows, flag_duplicates
from tickscope.operators.dedup import price_windows as window_moments
from tickscope.operators.ingest import validate_ticks as split_ticks
from tickscope.operators.trades import latest_tick as newest_tick
from tickscope.plans.item_queries import PUBLISHED, macro_sql, ntz
from tickscope.plans.registry import Views, query
from tickscope.session import stored


def dedup_sql(source: str, window_s: int) -> str:
    """WITH RECURSIVE members ``numbered`` and ``walk``: one step per tick of an item."""
    return f"""
      numbered AS (SELECT *, row_number() OVER (PARTITION BY market_hash_name ORDER BY timestamp, id) AS rn FROM {source}),
      walk AS (
        SELECT id, market_hash_name, rn, price_cents AS last_price, timestamp AS last_second, false AS is_duplicate
        FROM numbered WHERE rn = 1
        UNION ALL
        SELECT n.id, n.market_hash_name, n.rn, n.price_cents,
               CASE WHEN n.price_cents = w.last_price AND n.timestamp - w.last_second < {window_s}
                 THEN w.last_second ELSE n.timestamp END,
               n.price_cents = w.last_price AND n.timestamp - w.last_second < {window_s}
        FROM walk AS w JOIN numbered AS n ON n.market_hash_name = w.market_hash_name AND n.rn = w.rn + 1)"""


DETECT = f"""
      {dedup_sql("fx_live_ticks", 300)},
      accepted AS (SELECT n.* FROM numbered AS n JOIN walk AS w ON w.id = n.id WHERE NOT w.is_duplicate),
      windowed AS (
        SELECT id, market_hash_name, timestamp, price_cents, float_value, stickers, count(price_cents) OVER w AS n,
               coalesce(sum(price_cents) OVER w, 0) AS sx, coalesce(sum(price_cents * price_cents) OVER w, 0) AS sxx
        FROM accepted WINDOW w AS (PARTITION BY market_hash_name ORDER BY timestamp, id
                                   ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)),
      {macro_sql("fx_sales", "id")},
      published AS ({PUBLISHED}),
      stats AS (
        SELECT w.*, p.* EXCLUDE (market_hash_name), p.market_hash_name IS NOT NULL AS has_baseline,
               CAST(sx AS DOUBLE) / nullif(CAST(n AS DOUBLE), 0) AS mean,
               CASE WHEN n > 1 THEN CAST(n * sxx - sx * sx AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE) ELSE 0.0 END AS var,
               coalesce(volatility_cents > 0 AND rolling_30d_avg_cents > 0, false) AS usable
        FROM windowed AS w LEFT JOIN published AS p ON p.market_hash_name = w.market_hash_name),
      sourced AS (
        SELECT *, CASE WHEN n < 3 AND usable THEN 'macro' WHEN n < 3 THEN NULL
                       WHEN usable AND cv_published > 0 THEN 'hybrid' ELSE 'local' END AS source FROM stats),
      scored AS (
        SELECT *, CASE source
                 WHEN 'macro' THEN (price_cents - rolling_30d_avg_cents)
                   / greatest(CAST(volatility_cents AS DOUBLE), rolling_30d_avg_cents * CAST(0.01 AS DOUBLE))
                 WHEN 'hybrid' THEN (price_cents - mean) / sqrt(
                   (n * var + CAST(5 AS DOUBLE) * ((mean * cv_published) * (mean * cv_published))) / (n + CAST(5 AS DOUBLE)))
                 WHEN 'local' THEN (price_cents - mean) / greatest(sqrt(var), mean * CAST(0.04 AS DOUBLE)) END AS z_score,
               CASE source WHEN 'macro' THEN CAST(rolling_30d_avg_cents AS DOUBLE) WHEN 'hybrid' THEN mean
                           WHEN 'local' THEN mean END AS mean_cents,
               len(stickers) AS sticker_count FROM sourced)"""

DECIDE = f"""
      {DETECT},
      hits AS (
        SELECT * FROM scored WHERE z_score < CASE WHEN sticker_count > 0 THEN -1.0 ELSE -2.0 END
          AND (sticker_count > 0 OR mean_cents - price_cents >= 50)),
      valued AS (
        SELECT h.id, CAST(sum(coalesce(TRY_CAST(p.price AS BIGINT), 0)) AS BIGINT) AS sticker_value_cents
        FROM (SELECT id, unnest(stickers).name AS name FROM hits) AS h
        LEFT JOIN fx_sticker_prices AS p ON p.name = h.name GROUP BY h.id),
      priced AS (
        SELECT h.*, coalesce(v.sticker_value_cents, 0) AS sticker_value_cents FROM hits AS h
        LEFT JOIN valued AS v ON v.id = h.id),
      decisions AS (
        SELECT id, market_hash_name, timestamp, price_cents, float_value, z_score, mean_cents, source, sticker_count,
               sticker_value_cents, reason NOT IN ('no_baseline', 'no_edge') AS approved, reason,
               coalesce(latest_price_cents, price_cents) - price_cents AS estimated_profit_cents,
               make_timestamp(timestamp * 1000000) AS event_time
        FROM (SELECT *, CASE
                WHEN NOT has_baseline THEN 'no_baseline'
                WHEN price_cents <= coalesce(support_floor_cents, 0) THEN 'support_floor'
                WHEN volatility_cents > 0 AND (CAST(rolling_30d_avg_cents - price_cents AS DOUBLE)
                     / CAST(volatility_cents AS DOUBLE)) >= 2.0 THEN 'two_sigma'
                WHEN sticker_value_cents > 10000 AND price_cents - latest_price_cents <= 0 THEN 'free_stickers'
                WHEN sticker_value_cents > 10000 AND CAST(price_cents - latest_price_cents AS DOUBLE)
                     / CAST(sticker_value_cents AS DOUBLE) * 100 <= 3.0 THEN 'sticker_premium'
                ELSE 'no_edge' END AS reason FROM priced))"""

DECISION_COLUMNS = (
    "id, market_hash_name, timestamp, price_cents, float_value, z_score, mean_cents, source, sticker_count, "
    "sticker_value_cents, approved, reason, estimated_profit_cents"
)


def published(v: Views) -> DataFrame:
    return stored(B.publish_baselines(v.items, B.macro_baselines(v.sales, ["id"])))


def decisions(v: Views) -> DataFrame:
    return A.detect_anomalies(v.live_ticks, published(v), v.sticker_prices)


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds("timestamp"))


@query("validate_ticks", """
    SELECT event_id, value AS price_usd, CAST(round_even(value * 100, 0) AS BIGINT) AS price_cents, user_id
    FROM events WHERE value > 0""")
def validate_ticks(v: Views) -> DataFrame:
    raw = v.table("events").select(
        "event_id", "user_id", F.col("event_type").alias("market_hash_name"), F.col("value").alias("price_usd"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
    )
    return split_ticks(raw, F.lit(0)).good.select("event_id", "price_usd", "price_cents", "user_id")


# Every reason for a rejection occurs: names go missing, prices become NaN, too large, zero or negative.
BENT = """
    bent AS (
      SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS market_hash_name,
             CASE WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 17 = 0 THEN CAST(1e30 AS DOUBLE)
                  WHEN event_id % 19 = 0 THEN -value WHEN event_id % 23 = 0 THEN CAST(0 AS DOUBLE)
                  WHEN event_id % 29 = 0 THEN NULL ELSE value END AS price_usd
      FROM events)"""


@query("rejected_ticks", f"""
    WITH {BENT}
    SELECT event_id, error FROM (
      SELECT event_id, CASE WHEN market_hash_name IS NULL THEN 'name is missing'
        WHEN price_usd IS NULL OR isnan(price_usd) THEN 'price is missing' WHEN price_usd <= 0 THEN 'price must be positive'
        WHEN price_usd >= 1e29 THEN 'price is out of range' END AS error FROM bent)
    WHERE error IS NOT NULL""")
def rejected_ticks(v: Views) -> DataFrame:
    number = F.col("event_id")
    price = (F.when(number % 13 == 0, F.lit(float("nan"))).when(number % 17 == 0, F.lit(1e30)).when(number % 19 == 0, -F.col("value"))
             .when(number % 23 == 0, F.lit(0.0)).when(number % 29 == 0, F.lit(None)).otherwise(F.col("value")))
    raw = v.table("events").select(
        "event_id", F.when(number % 11 != 0, F.col("event_type")).alias("market_hash_name"), price.alias("price_usd"),
        F.lit(None).cast("bigint").alias("timestamp"),
    )
    return split_ticks(raw, F.lit(0)).bad.select("event_id", "error")


@query("dedup_ticks", f"""
    WITH RECURSIVE {dedup_sql("fx_dedup", 3600)}
    SELECT n.id, n.market_hash_name, n.price_cents, n.timestamp FROM numbered AS n JOIN walk AS w ON w.id = n.id
    WHERE NOT w.is_duplicate""")
def dedup_ticks(v: Views) -> DataFrame:
    return accepted_ticks(v.dedup, window_s=3600)


@query("dedup_ticks_default", f"""
    WITH RECURSIVE {dedup_sql("fx_dedup", 300)}
    SELECT id, is_duplicate FROM walk""")
def dedup_ticks_default(v: Views) -> DataFrame:
    return flag_duplicates(v.dedup).select("id", "is_duplicate")


@query("dedup_ticks_split", f"""
    WITH RECURSIVE {dedup_sql("fx_dedup", 14400)}
    SELECT id, is_duplicate FROM walk""")
def dedup_ticks_split(v: Views) -> DataFrame:
    """The way taken for hot items: every item is cut over several partitions."""
    return flag_duplicates(v.dedup, window_s=14400, limit=100).select("id", "is_duplicate")


WINDOW_SQL = """
    SELECT id, count(price_cents) OVER w AS n, CAST(coalesce(sum(price_cents) OVER w, 0) AS BIGINT) AS sx,
           CAST(coalesce(sum(price_cents * price_cents) OVER w, 0) AS BIGINT) AS sxx
    FROM fx_named_ticks WINDOW w AS (PARTITION BY market_hash_name ORDER BY timestamp, id
                                     ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)"""


@query("price_windows", WINDOW_SQL)
def price_windows(v: Views) -> DataFrame:
    return window_moments(v.named_ticks).select("id", "n", "sx", "sxx")


@query("price_windows_split", WINDOW_SQL)
def price_windows_split(v: Views) -> DataFrame:
    """The way taken for hot items: windows over runs of rows with a lead-in."""
    return window_moments(v.named_ticks, limit=40).select("id", "n", "sx", "sxx")


@query("baseline_lookup", f"""
    WITH {macro_sql("fx_sales", "id")}, published AS ({PUBLISHED})
    SELECT t.id, p.latest_price_cents, p.cv_published, p.market_hash_name IS NOT NULL AS has_baseline
    FROM fx_live_ticks AS t LEFT JOIN published AS p ON p.market_hash_name = t.market_hash_name""")
def baseline_lookup(v: Views) -> DataFrame:
    return A.with_baseline(v.live_ticks, published(v)).select("id", "latest_price_cents", "cv_published", "has_baseline")


@query("sticker_value", """
    SELECT s.id, CAST(sum(coalesce(TRY_CAST(p.price AS BIGINT), 0)) AS BIGINT) AS sticker_value_cents
    FROM (SELECT id, unnest(stickers).name AS name FROM fx_ticks) AS s
    LEFT JOIN fx_sticker_prices AS p ON p.name = s.name GROUP BY s.id""")
def sticker_value(v: Views) -> DataFrame:
    return A.sticker_value(v.ticks, v.sticker_prices)


@query("z_scores", f"""
    WITH RECURSIVE {DETECT}
    SELECT id, z_score, mean_cents, source, coalesce(z_score < CASE WHEN sticker_count > 0 THEN -1.0 ELSE -2.0 END
             AND (sticker_count > 0 OR mean_cents - price_cents >= 50), false) AS triggered
    FROM scored""")
def z_scores(v: Views) -> DataFrame:
    windowed = accepted_windows(v.live_ticks)
    scored = A.with_score(A.with_baseline(windowed, published(v)))
    trigger = scoring.anomaly_trigger(F.col("score.z"), F.col("score.mean"), F.col("price_cents"), F.size("stickers"))
    return scored.select("id", F.col("score.z").alias("z_score"), F.col("score.mean").alias("mean_cents"),
                         F.col("score.source").alias("source"), trigger.alias("triggered"))


@query("detect_anomalies_split", f"WITH RECURSIVE {DECIDE} SELECT {DECISION_COLUMNS} FROM decisions")
def detect_anomalies_split(v: Views) -> DataFrame:
    """The same with the limits for hot items so low that every item is cut."""
    return A.detect_anomalies(v.live_ticks, published(v), v.sticker_prices, limit=30)


@query("detect_anomalies", f"WITH RECURSIVE {DECIDE} SELECT {DECISION_COLUMNS} FROM decisions")
def detect_anomalies(v: Views) -> DataFrame:
    return decisions(v)


@query("append_trades", f"""
    WITH RECURSIVE {DECIDE}
    SELECT CAST(d.id AS VARCHAR) AS id, i.id AS item_id, price_cents AS purchase_price_cents, estimated_profit_cents,
           event_time AS simulated_buy_timestamp
    FROM decisions AS d JOIN fx_items AS i ON i.market_hash_name = d.market_hash_name WHERE approved""")
def append_trades(v: Views) -> DataFrame:
    # z is stored to 4 decimals, where the two engines treat exact ties differently
    return ntz(A.append_trades(decisions(v), v.items).trades.drop("trigger_z_score"), "simulated_buy_timestamp")


@query("append_trades_new_items", f"""
    WITH RECURSIVE {DECIDE},
    known AS (SELECT * FROM fx_items WHERE id % 3 <> 0),
    fresh AS (
      SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY name) AS id, name AS market_hash_name
      FROM (SELECT DISTINCT market_hash_name AS name FROM decisions WHERE approved)
      WHERE name NOT IN (SELECT market_hash_name FROM known)),
    everyone AS (SELECT id, market_hash_name FROM known UNION ALL SELECT * FROM fresh)
    SELECT CAST(d.id AS VARCHAR) AS id, i.id AS item_id, price_cents AS purchase_price_cents, estimated_profit_cents
    FROM decisions AS d JOIN everyone AS i ON i.market_hash_name = d.market_hash_name WHERE approved""")
def append_trades_new_items(v: Views) -> DataFrame:
    """A third of the items is unknown before the trades name them."""
    log = A.append_trades(decisions(v), v.items.filter("id % 3 <> 0"))
    return log.trades.select("id", "item_id", "purchase_price_cents", "estimated_profit_cents")


@query("latest_tick", """
    SELECT item_id, arg_max(float_value, (inserted_at, id)) AS float_value FROM fx_ticks GROUP BY item_id""")
def latest_tick(v: Views) -> DataFrame:
    return newest_tick(v.ticks)


@query("source_baseline", """
    SELECT item_id, avg(price_cents) AS avg_source FROM fx_ticks WHERE marketplace_source = 'purchase' GROUP BY item_id""")
def source_baseline(v: Views) -> DataFrame:
    return C.source_baseline(v.ticks, "purchase")


TIERS = """CASE WHEN f >= 0.0 AND f < 0.07 THEN 'Factory New' WHEN f >= 0.07 AND f < 0.15 THEN 'Minimal Wear'
                WHEN f >= 0.15 AND f < 0.38 THEN 'Field-Tested' WHEN f >= 0.38 AND f < 0.45 THEN 'Well-Worn'
                WHEN f >= 0.45 AND f < 1.01 THEN 'Battle-Scarred' ELSE 'Unknown' END"""
QUALITY = """CASE WHEN f < 0 OR f > 1 THEN 'Standard' WHEN f < 0.01 THEN 'Exceptional' WHEN f < 0.03 THEN 'Excellent'
                  WHEN f < 0.08 THEN 'Good' WHEN f < 0.10 THEN 'Decent' WHEN f < 0.16 THEN 'Good'
                  WHEN f < 0.20 THEN 'Decent' WHEN f >= 0.95 THEN 'Exceptional' WHEN f >= 0.90 THEN 'Notable'
                  ELSE 'Standard' END"""
MULTIPLIER = """CAST(CASE WHEN f < 0 OR f > 1 THEN 1.0 WHEN f < 0.01 THEN 1.5 WHEN f < 0.03 THEN 1.3 WHEN f < 0.07 THEN 1.1
                     WHEN f < 0.08 THEN 1.15 WHEN f < 0.10 THEN 1.05 WHEN f < 0.16 THEN 1.1 WHEN f < 0.20 THEN 1.03
                     WHEN f >= 0.95 THEN 1.3 WHEN f >= 0.90 THEN 1.15 ELSE 1.0 END AS DOUBLE)"""


@query("wear_quality", f"""
    SELECT id, {TIERS} AS wear_tier, {QUALITY} AS quality, {MULTIPLIER} AS multiplier
    FROM (SELECT id, float_value * CAST(1.1 AS DOUBLE) - CAST(0.02 AS DOUBLE) AS f FROM fx_ticks)""")
def wear_quality(v: Views) -> DataFrame:
    # stretched a little, so that values outside 0..1 occur
    value = F.col("float_value") * F.lit(1.1) - F.lit(0.02)
    graded = v.ticks.select("id", wear.wear_tier(value).alias("wear_tier"), wear.float_quality(value).alias("q"))
    return graded.select("id", "wear_tier", "q.quality", "q.multiplier")


@query("tick_rates", f"""
    WITH RECURSIVE {dedup_sql("fx_dedup", 3600)}
    SELECT time_bucket(INTERVAL 1 MINUTE, make_timestamp(n.timestamp * 1000000)) AS window_start,
           count(*) FILTER (WHERE NOT w.is_duplicate) / CAST(60 AS DOUBLE) AS processed_per_s,
           count(*) FILTER (WHERE w.is_duplicate) / CAST(60 AS DOUBLE) AS deduplicated_per_s
    FROM numbered AS n JOIN walk AS w ON w.id = n.id GROUP BY ALL""")
def tick_rates(v: Views) -> DataFrame:
    return ntz(M.tick_rates(timed(flag_duplicates(v.dedup, window_s=3600))), "window_start")


@query("anomaly_rates", f"""
    WITH RECURSIVE {DECIDE}
    SELECT time_bucket(INTERVAL 1 MINUTE, event_time) AS window_start, source, count(*) AS anomalies
    FROM decisions GROUP BY ALL""")
def anomaly_rates(v: Views) -> DataFrame:
    return ntz(M.anomaly_rates(timed(decisions(v))), "window_start")


@query("decision_rates", f"""
    WITH RECURSIVE {DECIDE}
    SELECT time_bucket(INTERVAL 1 MINUTE, event_time) AS window_start, count(*) FILTER (WHERE approved) AS confirmed,
           count(*) FILTER (WHERE NOT approved) AS rejected
    FROM decisions GROUP BY ALL""")
def decision_rates(v: Views) -> DataFrame:
    return ntz(M.decision_rates(timed(decisions(v))), "window_start")


SLIDING = """
      rates AS (
        SELECT window_start, count(*) FILTER (WHERE approved) AS confirmed, count(*) AS decided,
               CAST(count(*) FILTER (WHERE approved) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS confirmation_rate
        FROM (SELECT approved, unnest(generate_series(
                time_bucket(INTERVAL 1 MINUTE, event_time) - INTERVAL 14 MINUTE,
                time_bucket(INTERVAL 1 MINUTE, event_time), INTERVAL 1 MINUTE)) AS window_start FROM decisions)
        GROUP BY window_start)"""


@query("confirmation_rate", f"WITH RECURSIVE {DECIDE}, {SLIDING} SELECT * FROM rates")
def confirmation_rate(v: Views) -> DataFrame:
    return ntz(M.confirmation_rate(timed(decisions(v))), "window_start")


@query("alerts", f"""
    WITH RECURSIVE {DECIDE}, {SLIDING},
    minutes AS (SELECT time_bucket(INTERVAL 1 MINUTE, event_time) AS window_start, count(*) AS anomalies
                FROM decisions GROUP BY ALL),
    high AS (SELECT window_start, count(CASE WHEN anomalies > 50 THEN 1 END) OVER (ORDER BY window_start
               RANGE BETWEEN INTERVAL 1 MINUTE PRECEDING AND CURRENT ROW) AS hits FROM minutes),
    low AS (SELECT window_start, count(CASE WHEN confirmation_rate < 0.1 THEN 1 END) OVER (ORDER BY window_start
              RANGE BETWEEN INTERVAL 14 MINUTE PRECEDING AND CURRENT ROW) AS hits FROM rates)
    SELECT window_start, 'high_anomaly_rate' AS alert FROM high WHERE hits = 2
    UNION ALL SELECT window_start, 'low_confirmation_rate' FROM low WHERE hits = 15""")
def alerts(v: Views) -> DataFrame:
    found = timed(decisions(v))
    return ntz(M.alerts(M.anomaly_rates(found), M.confirmation_rate(found)), "window_start")


@query("colocated_lookups", f"""
    WITH {macro_sql("fx_sales", "id")}
    SELECT t.id, t.item_id, i.market_hash_name, i.item_type, t.price_cents, m.latest_price_cents, m.support_floor_cents,
           t.price_cents - m.latest_price_cents AS premium_cents
    FROM fx_named_ticks AS t LEFT JOIN fx_items AS i ON i.id = t.item_id AND i.item_type <> 'Glove'
    LEFT JOIN macro AS m ON m.item_id = t.item_id""")
def colocated_lookups(v: Views) -> DataFrame:
    """Ticks with their item and baseline, from tables in buckets of the item; gloves are left out of the items."""
    ticks = v.named_ticks.select("id", "item_id", "price_cents")
    layout = CO.layout_for(ticks, "item_id")
    items = v.items.filter("item_type <> 'Glove'").select(F.col("id").alias("item_id"), "market_hash_name", "item_type")
    macro = B.macro_baselines(v.sales, ["id"]).select("item_id", "latest_price_cents", "support_floor_cents")
    named = CO.colocated(CO.bucketed_facts(ticks, layout), CO.bucketed_lookup(items, layout), layout)
    joined = CO.colocated(named, CO.bucketed_lookup(macro, layout), layout)
    return joined.select(
        "id", "item_id", "market_hash_name", "item_type", "price_cents", "latest_price_cents", "support_floor_cents",
        (F.col("price_cents") - F.col("latest_price_cents")).alias("premium_cents"),
    )
