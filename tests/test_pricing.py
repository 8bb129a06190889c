import pytest
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.functions import pricing

BIG = "bigint"


def history(day=None, week=None, month=None, quarter=None):
    """Sales-history literal; a window is (median, volume)."""
    def window(pair):
        median, volume = pair or (None, None)
        return F.struct(F.lit(median).cast("string").alias("median"), F.lit(volume).cast(BIG).alias("volume"))

    fields = [F.lit(None).alias(n) for n in ("version", "item_page", "market_page")]
    return F.struct(
        *fields, *[window(p).alias(n) for p, n in zip((day, week, month, quarter), pricing.WINDOWS)]
    ).cast(schemas.SALES_HISTORY)


@pytest.mark.parametrize("usd, cents", [(0.125, 12), (0.375, 38), (10.5, 1050), (None, None), (1.005, 100)])
def test_cents_round_half_to_even(value, usd, cents):
    assert value(pricing.to_cents(F.lit(usd).cast("double"))) == cents


@pytest.mark.parametrize("windows, median", [
    ([("10.0", 5), ("11", 9), None, None], 10.0),
    ([("10.0", 0), ("11.0", 9), None, None], 11.0),
    ([("0", 4), ("boom", 9), ("12.5", 3), None], 12.5),
    ([None, None, ("12", 0), ("13", None)], 13.0),
    ([("10", None), None, None, None], None),
    ([None, None, None, None], None),
    ([("NaN-ish", 3), None, None, ("9", 0)], 9.0),
])
def test_recent_median(value, windows, median):
    assert value(pricing.recent_median(history(*windows))) == median


@pytest.mark.parametrize("windows, detected, severity", [
    ([("700", 1), ("700", 1), ("690", 1), ("690", 1)], False, 0.0),
    ([("600", 1), ("700", 1), ("700", 1), ("700", 1)], True, 100 / 700),
    ([None, ("80", 1), ("100", 1), None], True, 0.2),
    ([("80", 1), None, None, ("100", 1)], True, 0.2),
    ([("72", 1), ("80", 1), ("100", 1), None], True, 0.2 + 0.1),
    ([None, None, None, None], False, 0.0),
])
def test_downtrend(value, windows, detected, severity):
    result = value(pricing.downtrend(history(*windows)))
    assert result.detected is detected
    assert result.severity == pytest.approx(severity)


@pytest.mark.parametrize("kind, discount", [("Knife", .25), ("Glove", .25), ("Sticker", .35), ("Patch", .35), ("Agent", .30)])
def test_discount(value, kind, discount):
    assert value(pricing.discount_corridor(F.lit(kind))) == discount


@pytest.mark.parametrize("has, latest, volume, kind, liquid", [
    (True, 20000, 0.06, "Weapon Skin", True),
    (True, 20000, 0.04, "Weapon Skin", False),
    (True, 15000, 0.4, "Weapon Skin", False),
    (True, 15001, 0.4, "Weapon Skin", True),
    (True, 100, 0.06, "Knife", True),
    (True, 100, 0.5, "Weapon Skin", True),
    (True, 100, None, "Weapon Skin", True),
    (False, None, None, "Weapon Skin", True),
])
def test_liquidity(value, has, latest, volume, kind, liquid):
    column = pricing.is_liquid(F.lit(has), F.lit(latest).cast(BIG), F.lit(volume).cast("double"), F.lit(kind))
    assert value(column) is liquid


@pytest.mark.parametrize("steam, reference, shift", [
    (100000.0, 70000.0, False), (None, 70000.0, False), (100000.0, None, False), (100000.0, 0.0, False),
    (270.0, 140.0, False), (271.0, 140.0, True),
])
def test_regime_shift(value, steam, reference, shift):
    # 270 * 0.7 = 189 is exactly 35 % above 140
    column = pricing.regime_shift(F.lit(steam).cast("double"), F.lit(reference).cast("double"), F.lit(0.30))
    assert value(column) is shift


def test_threshold(value):
    def threshold(cash, falling, severity):
        return value(pricing.snipe_threshold(F.lit(cash).cast(BIG), F.lit(falling), F.lit(severity)))

    assert threshold(70000, False, 0.0) == 59500
    assert threshold(60000, True, 100 / 700) == 42429
    assert threshold(10000, True, 0.9) == 7000
    assert threshold(None, False, 0.0) is None


def test_cash_equivalent_order(value):
    def cash(liquid, median, steam, source, shift):
        return value(pricing.cash_equivalent(
            F.lit(liquid), F.lit(median).cast(BIG), F.lit(steam).cast("double"), F.lit(source).cast("double"),
            F.lit(shift), F.lit(0.25)))

    assert cash(True, 500, 1000.0, 700.0, False) == 500
    assert cash(True, None, 1000.0, 700.0, False) == 750
    assert cash(True, None, 1000.0, 700.4, True) == 700
    assert cash(True, None, None, None, False) is None
    assert cash(False, 500, 1000.0, 700.0, False) is None
