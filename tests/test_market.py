from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.operators import baselines as B
from tickscope.operators import context as C
from tickscope.operators import monitoring as M
from tickscope.operators import trades as T

DAY = datetime(2024, 1, 1)
HISTORY = "item_id BIGINT, sale_date TIMESTAMP, median_price_cents BIGINT, volume_sold BIGINT"
ITEMS = "id BIGINT, market_hash_name STRING, item_type STRING, rarity STRING"
KNIFE = "★ Butterfly Knife | Doppler (Factory New)"
PHASE = "★ Butterfly Knife | Doppler (Phase 3) (Factory New)"


def prices(spark, values, item=1, volume=10):
    return spark.createDataFrame([(item, DAY + timedelta(days=i), p, volume) for i, p in enumerate(values)], HISTORY)


def test_flat_history(spark):
    row = B.macro_baselines(prices(spark, [10000] * 35)).first()
    assert (row.latest_price_cents, row.rolling_30d_avg_cents, row.rolling_90d_avg_cents) == (10000, 10000, 10000)
    assert (row.drift_percent, row.volatility_cents, row.support_floor_cents) == (0.0, 0, 10000)
    assert (row.avg_volume_30d, row.cv_latest, row.total_points_analyzed) == (10.0, 0.0, 35)


def test_single_point(spark):
    row = B.macro_baselines(prices(spark, [500], volume=3)).first()
    assert (row.latest_price_cents, row.volatility_cents, row.support_floor_cents) == (500, 0, 500)
    assert row.avg_volume_30d == 3.0


def test_downtrend_history(spark):
    values = [10000] * 15 + [6000 - 10 * i for i in range(30)]
    row = B.macro_baselines(prices(spark, values)).first()
    recent = values[-30:]
    mean = sum(recent) / 30
    deviation = (sum((p - mean) ** 2 for p in recent) / 29) ** 0.5
    assert row.drift_percent < 0
    assert row.latest_price_cents == 5710
    assert row.volatility_cents == round(deviation)
    assert row.rolling_90d_avg_cents == round(sum(values) / 45)
    assert row.cv_latest == round(deviation) / 5710


def test_no_history_no_row(spark):
    assert B.macro_baselines(prices(spark, [1]).limit(0)).count() == 0


def test_seasonality(spark):
    maps = B.seasonality_maps(prices(spark, [100] * 31 + [200] * 10)).first()
    assert maps.monthly_seasonality == {1: 100.0, 2: 200.0}


def baselines(spark, rows):
    columns = ("item_id BIGINT, latest_price_cents BIGINT, rolling_30d_avg_cents BIGINT, rolling_90d_avg_cents BIGINT, "
               "drift_percent DOUBLE, volatility_cents BIGINT, avg_volume_30d DOUBLE, support_floor_cents BIGINT")
    return spark.createDataFrame(rows, columns)


def test_upsert_and_publish(spark):
    now = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    old = baselines(spark, [(1, 1, 1, 1, 0.0, 1, 1.0, 1), (2, 2, 2, 2, 0.0, 2, 2.0, 2)]).withColumn(
        "updated_at", F.expr("TIMESTAMP '2023-01-01 00:00:00'"))
    new = baselines(spark, [(1, 1600, 2000, 1900, 2.5, 100, 3.0, 1500), (3, 5, None, None, 0.0, 7, 1.0, 5)])
    merged = B.upsert_baselines(new, old, now)
    assert {r.item_id: (r.latest_price_cents, r.updated_at.year) for r in merged.collect()} == {
        1: (1600, 2024), 2: (2, 2023), 3: (5, 2024)}
    items = spark.createDataFrame(
        [(1, "AK-47 | Redline (Field-Tested)", "Weapon Skin", None), (3, "Sticker | Titan", "Sticker", None)], ITEMS)
    published = {r.market_hash_name: r for r in B.publish_baselines(items, merged).collect()}
    assert published["AK-47 | Redline (Field-Tested)"].cv_published == 0.05
    assert published["Sticker | Titan"].cv_published == 0.0
    assert '"coefficient_of_variation":0.05' in published["AK-47 | Redline (Field-Tested)"].payload_json
    stickers = B.publish_sticker_prices(items, merged).collect()
    assert [tuple(r) for r in stickers] == [("Sticker | Titan", "5")]


def test_macro_refresh_of_the_first_items(spark):
    items = spark.createDataFrame([(1, "a", "Agent", None), (2, "b", "Agent", None)], ITEMS)
    history = prices(spark, [5]).unionByName(prices(spark, [6], item=2))
    old = B.macro_baselines(history).withColumn("updated_at", F.current_timestamp()).limit(0)
    some = B.macro_refresh(items, history, old, F.current_timestamp(), 1)
    assert [r.item_id for r in some.collect()] == [1]
    assert B.macro_refresh(items, history, old, F.current_timestamp(), 0).count() == 2


def entry(version, page, **windows):
    base = {"version": version, "item_page": page, "market_page": None}
    return (*base.values(), *[windows.get(w) for w in ("day", "week", "month", "quarter")])


def sales(spark, rows):
    return spark.createDataFrame(rows, f"base_name STRING, pos INT, entry {schemas.SALES_HISTORY}")


@pytest.fixture
def market(spark):
    items = spark.createDataFrame([(1, KNIFE, "Knife", None), (2, PHASE, "Knife", None)], ITEMS)
    history = prices(spark, [100000, 100000])
    ticks = spark.createDataFrame(
        [(2, 70000, "skinport"), (2, 70000, "skinport"), (2, 50000, "other")],
        "item_id BIGINT, price_cents BIGINT, marketplace_source STRING")
    macro = baselines(spark, [(2, 70000, 70000, 70000, 1.5, 900, 2.5, 65000)])
    return items, history, ticks, macro


def ask(spark, market, sales_rows, name=PHASE, **changes):
    items, history, ticks, macro = market
    requests = spark.createDataFrame([(name,), (name,), ("unknown",)], "market_hash_name STRING")
    parts = {"items": items, "history": history, "ticks": ticks, "baselines": macro, **changes}
    rows = C.market_context(requests=requests, sales=sales(spark, sales_rows), **parts).collect()
    assert len(rows) == 1
    return rows[0].asDict()


FLAT = {"day": ("700.0", 5), "week": ("700.0", 9), "month": ("690.0", 30), "quarter": ("690", 90)}


def test_context_record(spark, market):
    rows = [(KNIFE, 0, entry("Phase 1", "/one", day=("1.0", 1))), (KNIFE, 1, entry("Phase 3", "/three", **FLAT))]
    assert ask(spark, market, rows) == {
        "market_hash_name": PHASE, "historical_steam_avg_cents": 100000, "historical_skinport_avg_cents": 70000,
        "real_time_skinport_median_cents": 70000, "cash_equivalent_avg_cents": 70000, "snipe_threshold_cents": 59500,
        "item_type": "Knife", "is_liquid": True, "avg_volume_30d": 2.5, "drift_percent": 1.5, "volatility_cents": 900,
        "support_floor_cents": 65000, "regime_shift_detected": False, "downtrend_detected": False,
        "downtrend_severity": 0.0, "item_page": "/three", "market_page": None,
    }


def test_context_in_a_downtrend(spark, market):
    falling = {**FLAT, "day": ("600.0", 5), "month": ("700", 1)}
    row = ask(spark, market, [(KNIFE, 0, entry("Phase 3", None, **falling))])
    assert row["downtrend_detected"] and row["downtrend_severity"] == pytest.approx(100 / 700)
    assert (row["cash_equivalent_avg_cents"], row["snipe_threshold_cents"]) == (60000, 51000 - 8571)


def test_context_of_an_illiquid_item(spark, market):
    macro = baselines(spark, [(2, 70000, 70000, 70000, 1.5, 900, 0.01, 65000)])
    row = ask(spark, market, [(KNIFE, 0, entry("Phase 3", None, **FLAT))], baselines=macro)
    assert not row["is_liquid"]
    assert (row["cash_equivalent_avg_cents"], row["snipe_threshold_cents"]) == (None, None)
    assert row["real_time_skinport_median_cents"] == 70000


def test_context_falls_back_without_sales_history(spark, market):
    row = ask(spark, market, [])
    assert row["cash_equivalent_avg_cents"] == 75000  # steam less 25 %: no regime shift against 70000
    shifted = ask(spark, market, [], history=prices(spark, [200000]))
    assert shifted["regime_shift_detected"] and shifted["cash_equivalent_avg_cents"] == 70000
    bare = ask(spark, market, [], history=prices(spark, [1]).limit(0), ticks=market[2].limit(0),
               baselines=market[3].limit(0))
    assert (bare["cash_equivalent_avg_cents"], bare["is_liquid"], bare["volatility_cents"]) == (None, True, 0)
    assert (bare["drift_percent"], bare["support_floor_cents"]) == (0.0, None)


def test_context_of_a_version_without_own_item(spark, market):
    other = PHASE.replace("Phase 3", "Ruby")
    row = ask(spark, market, [(KNIFE, 0, entry("Phase 1", "/one", **FLAT))], name=other)
    # ticks and baseline of the base item (none), the first sales entry as no version matches
    assert (row["historical_skinport_avg_cents"], row["item_page"]) == (None, "/one")


def test_sticker_price_chain(spark):
    items = spark.createDataFrame([(i, n, "Sticker", None) for i, n in enumerate("abcd")], ITEMS)
    history = prices(spark, [101, 102], item=1)
    ticks = spark.createDataFrame([(1, 9, "x"), (2, 30, "x"), (2, 31, "y")],
                                  "item_id BIGINT, price_cents BIGINT, marketplace_source STRING")
    wanted = spark.createDataFrame([(n,) for n in "abcdz"], "name STRING")
    found = C.sticker_price(wanted, sales(spark, [("a", 0, entry(None, None, week=("2.50", 3)))]), items, history, ticks)
    assert {r.name: r.price_cents for r in found.collect()} == {"a": 250, "b": 102, "c": 30, "d": None, "z": None}


def test_search(spark):
    items = spark.createDataFrame([(i, f"Name {i:02d} KNIFE", "Knife", None) for i in range(15)], ITEMS)
    macro = baselines(spark, [(i, i, i, i, 0.0, i, 1.0, i) for i in range(0, 15, 2)])
    found = C.search_baselines(items, macro, "knife").collect()
    # ten names first, then those without a baseline leave
    assert [r.market_hash_name for r in sorted(found)] == [f"Name {i:02d} KNIFE" for i in (0, 2, 4, 6, 8)]
    assert C.search_baselines(items, macro, "").count() == 0
    assert C.search_baselines(items, macro, "0_ k").count() == 5


def test_latest_tick_keeps_a_null_wear(spark):
    ticks = spark.createDataFrame(
        [(1, 1, DAY, 0.5, "x"), (2, 1, DAY + timedelta(1), None, "x"), (3, 2, DAY, 0.1, "y")],
        "id BIGINT, item_id BIGINT, inserted_at TIMESTAMP, float_value DOUBLE, marketplace_source STRING")
    assert {r.item_id: r.float_value for r in T.latest_tick(ticks).collect()} == {1: None, 2: 0.1}
    assert [r.item_id for r in T.latest_tick(ticks, "y").collect()] == [2]


def test_audit_without_context(spark):
    trades = spark.createDataFrame([("t", 1, 1000, 600, -3.0)],
                                   "id STRING, item_id BIGINT, purchase_price_cents BIGINT, estimated_profit_cents BIGINT, trigger_z_score DOUBLE")
    items = spark.createDataFrame([(1, "a", "Agent", None)], ITEMS)
    ticks = spark.createDataFrame([], "id BIGINT, item_id BIGINT, inserted_at TIMESTAMP, float_value DOUBLE, marketplace_source STRING")
    context = spark.createDataFrame(
        [], "market_hash_name STRING, is_liquid BOOLEAN, cash_equivalent_avg_cents BIGINT, "
            "real_time_skinport_median_cents BIGINT, snipe_threshold_cents BIGINT")
    row = T.audit_features(trades, items, ticks, context).first()
    assert (row.liquidity, row.live_floor_cents, row.wear_tier) == ("UNKNOWN", None, None)
    judged = T.apply_verdicts(T.audit_features(trades, items, ticks, context),
                              spark.createDataFrame([("t", 75, "fine ★")], "id STRING, score BIGINT, reasoning STRING"))
    assert (judged.first().verdict, judged.first().reasoning) == ("APPROVED", "fine ")


def minutes(spark, values, column="anomalies BIGINT", source=", source STRING"):
    start = datetime(2024, 1, 1, 23, 50)
    rows = [(start + timedelta(minutes=m), v, *(["local"] if source else [])) for m, v in values.items()]
    return spark.createDataFrame(rows, f"window_start TIMESTAMP, {column}{source}")


def test_alert_must_hold(spark):
    # over midnight; a missing minute and a calm minute break the run
    anomalies = minutes(spark, {0: 51, 1: 50, 2: 60, 9: 60, 10: 70, 11: 80, 13: 90})
    rates = minutes(spark, {m: 0.05 for m in range(16)}, "confirmation_rate DOUBLE", "")
    fired = {(r.alert, (r.window_start - datetime(2024, 1, 1, 23, 50)).seconds // 60) for r in M.alerts(anomalies, rates).collect()}
    assert fired == {("high_anomaly_rate", 10), ("high_anomaly_rate", 11), ("low_confirmation_rate", 14), ("low_confirmation_rate", 15)}


def test_pnl(spark):
    trades = spark.createDataFrame(
        [(DAY, 100), (DAY + timedelta(hours=1), -30), (DAY + timedelta(days=1), 5)],
        "event_time TIMESTAMP, estimated_profit_cents BIGINT")
    assert tuple(M.pnl_summary(trades).first()) == (3, 75)
    assert tuple(M.pnl_summary(trades.limit(0)).first()) == (0, 0)
    rows = M.pnl_running(trades).orderBy("hour").collect()
    assert [(r.running_trades, r.running_profit_cents) for r in rows] == [(1, 100), (2, 70), (3, 75)]
