import random
from dataclasses import replace

import pytest

from tickscope import schemas
from tickscope.functions.scoring import DEFAULTS
from tickscope.sources.tables import epochs_before
from tickscope.streaming.carried import STATE, advance, no_state, start_carried_path

TICKS = f"id BIGINT, market_hash_name STRING, price_cents BIGINT, timestamp BIGINT, float_value DOUBLE, stickers {schemas.STICKERS}"
TUNING = replace(DEFAULTS, window_size=5)


def batches(seed, n, per, late):
    """Micro-batches in which one item has half of all ticks; with ``late``, some go back in time."""
    rng, second, out = random.Random(seed), 10_000, []
    for b in range(n):
        rows = []
        for k in range(per):
            second += rng.randrange(0, 90)
            back = rng.choice([0, 0, 700, 5000]) if late else 0
            name = "hot" if rng.random() < 0.5 else f"n{rng.randrange(5)}"
            rows.append((b * 1000 + k, name, rng.choice([100, 100, 101]), second - back, None, []))
        out.append(rows)
    return out


def fold(stream, tuning):
    """Flags by order of arrival; windows of the kept accepted ticks before a tick in time, one tick after another."""
    last, members, flags, moments = {}, {}, {}, {}
    for rows in stream:
        added = {}
        for number, name, price, second, _, _ in sorted(rows, key=lambda r: (r[3], r[0])):
            before = last.get(name)
            flags[number] = before is not None and price == before[0] and second - before[1] < tuning.dedup_window_s
            if not flags[number]:
                last[name] = (price, second)
                added.setdefault(name, []).append((second, number, price))
        for name, new in added.items():
            union = sorted(members.get(name, []) + new)
            for row in new:
                prices = [p for _, _, p in union[:union.index(row)][-(tuning.window_size - 1):]]
                moments[row[1]] = (len(prices), sum(prices), sum(p * p for p in prices))
            members[name] = union[-(tuning.window_size - 1):]
    return flags, moments, last, members


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("limit", [7, 10_000])
def test_steps_equal_a_fold(spark, late, limit):
    stream = batches(3, 3, 90, late)
    state, flags, moments = no_state(spark), {}, {}
    for rows in stream:
        step = advance(spark.createDataFrame(rows, TICKS).repartition(3), state, TUNING, limit)
        for r in step.ticks.collect():
            flags[r.id] = r.is_duplicate
            if not r.is_duplicate:
                moments[r.id] = (r.n, r.sx, r.sxx)
        state = spark.createDataFrame(step.state.collect(), STATE)
    expected = fold(stream, TUNING)
    assert (flags, moments) == expected[:2] and sum(flags.values()) > 20
    got = {r.market_hash_name: r for r in state.collect()}
    assert {k: (r.last_price, r.last_second) for k, r in got.items()} == expected[2]
    assert {k: [tuple(m) for m in r.members] for k, r in got.items()} == expected[3]
    assert {r.seen for r in got.values()} == {max(r[3] for rows in stream for r in rows)}


def test_silent_items_leave_the_state(spark):
    def tick(number, name, second):
        return (number, name, 5, second, None, [])

    def run(rows, state):
        step = advance(spark.createDataFrame(rows, TICKS), state, TUNING, expire_s=600)
        return {r.id: r.is_duplicate for r in step.ticks.collect()}, spark.createDataFrame(step.state.collect(), STATE)

    _, state = run([tick(1, "a", 1000), tick(2, "b", 1500)], no_state(spark))
    _, state = run([tick(3, "b", 1700)], state)
    assert {r.market_hash_name for r in state.collect()} == {"b"}
    flags, state = run([tick(4, "a", 1100), tick(5, "b", 1750)], state)
    assert flags == {4: False, 5: True}  # "a" had expired, so the late tick starts it again
    assert {r.market_hash_name for r in state.collect()} == {"b"}  # and it is too old to be kept
    flags, state = run([], state)
    assert flags == {} and state.count() == 1
    with pytest.raises(ValueError):
        advance(spark.createDataFrame([], TICKS), state, TUNING, expire_s=10)


def test_stream_restarts_and_keeps_two_states(spark, tmp_path):
    stream = batches(8, 4, 30, True)
    items = spark.createDataFrame([(1, "hot", "Agent", None)], schemas.MARKET_ITEMS)
    baselines = spark.createDataFrame([("hot", 60, 100, 100, 12, 0.5, 0.12)],
                                      "market_hash_name STRING, support_floor_cents BIGINT, latest_price_cents BIGINT, "
                                      "rolling_30d_avg_cents BIGINT, volatility_cents BIGINT, drift_percent DOUBLE, cv_published DOUBLE")
    stickers = spark.createDataFrame([], "name STRING, price STRING")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(stream):
        spark.createDataFrame(rows, TICKS).write.parquet(f"{path}/chunk={k}")
        source = spark.readStream.schema(TICKS).option("recursiveFileLookup", True).parquet(path)
        start_carried_path(source, lambda: (items, baselines, stickers), out, str(tmp_path / "cp"), TUNING, 10,
                           available_now=True).awaitTermination()  # each start is a restart from the checkpoint
    flags, moments, _, _ = fold(stream, TUNING)
    got = {r.id: r for r in spark.read.parquet(f"{out}/ticks").collect()}
    assert {k: r.is_duplicate for k, r in got.items()} == flags
    assert {k: (r.n, r.sx, r.sxx) for k, r in got.items() if not r.is_duplicate} == moments
    assert epochs_before(spark, f"{out}/state", 99) == [2, 3]
