import math

import pytest
from pyspark.sql import functions as F

from tickscope.functions import audit, scoring, wear

BIG = "bigint"


def score(prices, avg=None, vol=None, cv=None, tuning=scoring.DEFAULTS):
    earlier = prices[:-1]
    moments = [len(earlier), sum(earlier), sum(p * p for p in earlier)]
    return scoring.z_score(
        F.lit(prices[-1]), *[F.lit(m).cast(BIG) for m in moments], F.lit(avg).cast(BIG), F.lit(vol).cast(BIG),
        F.lit(cv).cast("double"), tuning)


@pytest.mark.parametrize("prices, macro, z, source", [
    ([100, 102, 101, 99, 103], (), 1.9365, "local"),
    ([100, 102, 101, 99, 103], (100, 5, .05), None, "hybrid"),
    ([500, 500, 500, 500, 400], (), -5.0, "local"),
    ([100, 102], (101, 5), 0.2, "macro"),
    ([100], (10000, 1), -99.0, "macro"),
    ([100, 102, 101, 99, 103], (100, 0, .05), 1.9365, "local"),
    ([100, 102, 101, 99, 103], (100, 5, 0.0), 1.9365, "local"),
])
def test_z_score_cases(value, prices, macro, z, source):
    result = value(score(prices, *macro))
    assert result.source == source
    earlier = prices[:-1]
    mean = sum(earlier) / len(earlier) if earlier else None
    if source == "local":
        sd = math.sqrt(sum((p - mean) ** 2 for p in earlier) / (len(earlier) - 1))
        z = (prices[-1] - mean) / max(sd, 0.04 * mean)
    if source == "hybrid":
        variance = sum((p - mean) ** 2 for p in earlier) / (len(earlier) - 1)
        n = len(earlier)
        z = (prices[-1] - mean) / math.sqrt((n * variance + 5 * (mean * macro[2]) ** 2) / (n + 5))
    assert result.z == pytest.approx(z)


def test_known_values(value):
    assert value(score([100, 102, 101, 99, 103])).z == pytest.approx(0.622, abs=1e-3)
    assert value(score([100, 102, 101, 99, 103], 100, 5, .05)).z == pytest.approx(0.651, abs=1e-3)


def test_sparse_without_macro_is_null(value):
    assert value(score([100, 102])) is None
    assert value(score([100, 102], 101, 5, None, scoring.Tuning(macro_fallback=False))) is None


@pytest.mark.parametrize("price, z, mean, stickers, fires", [
    (500, -3.0, 600.0, 0, True), (500, -1.5, 600.0, 0, False), (500, -1.5, 600.0, 1, True),
    (580, -3.0, 600.0, 0, False), (580, -3.0, 600.0, 1, True), (500, -2.0, 600.0, 0, False),
    (550, -3.0, 600.0, 0, True), (551, -3.0, 600.0, 0, False), (500, -1.0, 600.0, 2, False),
])
def test_trigger(value, price, z, mean, stickers, fires):
    column = scoring.anomaly_trigger(F.lit(z), F.lit(mean), F.lit(price), F.lit(stickers))
    assert value(column) is fires


BASE = {"floor": 1500, "latest": 1600, "avg": None, "vol": None}


@pytest.mark.parametrize("price, stickers, base, approved, reason", [
    (1000, 0, BASE, True, "support_floor"),
    (1500, 0, BASE, True, "support_floor"),
    (1700, 0, BASE, False, "no_edge"),
    (6600, 500000, BASE, True, "sticker_premium"),
    (116600, 500000, BASE, False, "no_edge"),
    (1501, 500000, BASE, True, "free_stickers"),
    (1600, 10000, BASE, False, "no_edge"),
    (16600, 500000, BASE, True, "sticker_premium"),
    (16601, 500000, BASE, False, "no_edge"),
    (1200, 0, {"floor": 1000, "latest": 1600, "avg": 1600, "vol": 50}, True, "two_sigma"),
    (1500, 0, {"floor": 1000, "latest": 1600, "avg": 1600, "vol": 50}, True, "two_sigma"),
    (1550, 0, {"floor": 1000, "latest": 1600, "avg": 1600, "vol": 50}, False, "no_edge"),
    (1550, 0, {"floor": 1000, "latest": 1600, "avg": 1600, "vol": 0}, False, "no_edge"),
    (1000, 0, None, False, "no_baseline"),
])
def test_opportunity(value, price, stickers, base, approved, reason):
    known = base or dict.fromkeys(BASE)
    numbers = [F.lit(known[k]).cast(BIG) for k in ("floor", "latest", "avg", "vol")]
    result = value(scoring.opportunity(F.lit(price), F.lit(base is not None), *numbers, F.lit(stickers)))
    assert (result.approved, result.reason) == (approved, reason)


def test_profit(value):
    assert value(scoring.estimated_profit(F.lit(1600), F.lit(1000))) == 600
    assert value(scoring.estimated_profit(F.lit(None).cast(BIG), F.lit(1000))) == 0


@pytest.mark.parametrize("number, quality, tier", [
    (-0.1, "Standard", "Unknown"), (1.5, "Standard", "Unknown"), (0.005, "Exceptional", "Factory New"),
    (.02, "Excellent", "Factory New"), (.05, "Good", "Factory New"), (.09, "Decent", "Minimal Wear"),
    (.12, "Good", "Minimal Wear"), (.18, "Decent", "Field-Tested"), (.30, "Standard", "Field-Tested"),
    (.40, "Standard", "Well-Worn"), (.92, "Notable", "Battle-Scarred"), (.97, "Exceptional", "Battle-Scarred"),
    (1.0, "Exceptional", "Battle-Scarred"), (.07, "Good", "Minimal Wear"),
])
def test_wear(value, number, quality, tier):
    assert value(wear.float_quality(F.lit(number))).quality == quality
    assert value(wear.wear_tier(F.lit(number))) == tier


def test_null_wear(value):
    assert value(wear.float_quality(F.lit(None).cast("double"))) is None
    assert value(wear.wear_tier(F.lit(None).cast("double"))) is None


def test_audit_columns(value):
    def floor(*numbers):
        return value(audit.live_floor(*[F.lit(n).cast(BIG) for n in numbers]))

    assert floor(0, 50, 40) == 50
    assert floor(None, 0, 40) == 40
    assert floor(None, None, None) == 0
    assert value(audit.ascii_only(F.lit("★ naïve – ok"))) == " nave  ok"
    assert [value(audit.verdict(F.lit(s).cast(BIG))) for s in (70, 69, None, 101, -1)] == [
        "APPROVED", "REJECTED", "ERROR", "ERROR", "ERROR"]
    assert value(audit.liquidity_label(F.lit(True))) == "HIGH"
