import random
from statistics import mean

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickscope.operators import dedup as D
from tickscope.operators.baselines import rolling_averages
from tickscope.operators.joins import lookup
from tickscope.operators.ordering import largest_group, latest_rows, number_rows
from tickscope.operators.quantiles import exact_quantile


def skewed(n=600, seed=1):
    """Rows of which more than a third belong to one key."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", "b", "c"]), rng.randrange(n), i) for i in range(n)]


@pytest.mark.parametrize("limit", [10_000, 20])
def test_number_rows(spark, limit):
    rows = skewed()
    df = spark.createDataFrame(rows, "key STRING, at INT, id INT")
    got = {(r.key, r.id): r.n for r in number_rows(df, ["key"], ["at", "id"], "n", limit).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for i, row in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == key), start=1):
            want[(key, row[1])] = i
    assert got == want


@pytest.mark.parametrize("limit", [10_000, 20])
def test_number_rows_overall(spark, limit):
    df = spark.createDataFrame(skewed(), "key STRING, at INT, id INT")
    got = [r.n for r in number_rows(df, [], ["at", "id"], "n", limit).orderBy("at", "id").collect()]
    assert got == list(range(1, len(got) + 1))


def test_largest_group(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "key STRING")
    assert largest_group(df, ["key"]) == 2
    assert largest_group(df.limit(0), ["key"]) == 0


def test_latest_rows(spark):
    df = spark.createDataFrame(skewed(), "key STRING, at INT, id INT").repartition(7)
    got = latest_rows(df, "key", [F.desc("at"), F.desc("id")], 5, "rn", lanes=3).collect()
    frame = pd.DataFrame(skewed(), columns=["key", "at", "id"]).sort_values(["at", "id"], ascending=False)
    want = {(r.key, r.id) for r in frame.groupby("key").head(5).itertuples()}
    assert {(r.key, r.id) for r in got} == want
    assert sorted(r.rn for r in got if r.key == "hot") == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("limit", [10_000, 100])
def test_rolling_averages(spark, limit):
    rows = [("hot" if i % 3 else "cold", i // 2, i, (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "item_id STRING, sale_date INT, tie INT, median_price_cents BIGINT")
    got = {r.tie: (r.rolling_30d, r.rolling_90d) for r in rolling_averages(df, ["tie"], limit).collect()}
    assert len(got) == len(rows)
    for key in ("hot", "cold"):
        prices = [(r[2], r[3]) for r in rows if r[0] == key]
        for i, (tie, _) in enumerate(prices):
            window = [p for _, p in prices[: i + 1]]
            assert got[tie] == (pytest.approx(mean(window[-30:])), pytest.approx(mean(window[-90:])))


@pytest.mark.parametrize("rows", [100, 1])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_ways_agree(spark, rows, how):
    facts = spark.createDataFrame(
        [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}") for i in range(300)], "id INT, key STRING")
    table = spark.createDataFrame([("hot", 1, "x"), *[(f"k{i}", i, None) for i in range(30)]], "key STRING, v INT, w STRING")
    got = lookup(facts, table, "key", how, rows=rows, hot_keys=2).select("id", "key", "v", "w")
    want = facts.join(table, "key", how).select("id", "key", "v", "w")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("rows", [100, 1])
def test_lookup_of_a_key_list(spark, rows):
    facts = spark.createDataFrame([(i, f"k{i % 5}") for i in range(50)], "id INT, key STRING")
    keys = spark.createDataFrame([("k1",), ("k2",), ("k9",)], "key STRING")
    assert {r.key for r in lookup(facts, keys, "key", "inner", rows=rows, hot_keys=1).collect()} == {"k1", "k2"}


def test_lookup_salt_stays_in_the_join_key(spark):
    facts = spark.createDataFrame([(i, "hot") for i in range(50)], "id INT, key STRING")
    table = spark.createDataFrame([("hot", 1), ("k", 2)], "key STRING, v INT")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lookup(facts, table, "key", rows=1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert join.count("_salt") == 2


@pytest.mark.parametrize("q", [0.1, 0.5, 0.99])
def test_exact_quantile_matches_numpy(spark, q):
    rng = random.Random(3)
    rows = [(k, rng.choice([5, rng.randrange(-9000, 60000)])) for k in ("a", "b", "b", "b") for _ in range(150)]
    rows += [("one", 7), ("nulls", None)]
    df = spark.createDataFrame(rows, "key STRING, v BIGINT")
    got = {r.key: (r.q, r.n) for r in exact_quantile(df, ["key"], "v", q, "q").collect()}
    assert set(got) == {"a", "b", "one"}
    for key, (found, n) in got.items():
        values = [v for k, v in rows if k == key]
        assert n == len(values)
        assert found == np.quantile(values, q)


def greedy(rows, window):
    """Row-by-row definition: (key, second, id, price) -> accepted ids."""
    last, kept = {}, set()
    for key, second, tick, price in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key in last and last[key][0] == price and second - last[key][1] < window:
            continue
        last[key] = (price, second)
        kept.add(tick)
    return kept


TICKS = "market_hash_name STRING, timestamp BIGINT, id BIGINT, price_cents BIGINT"


@pytest.mark.parametrize("limit", [10_000, 1])
@pytest.mark.parametrize("case", ["edges", "constant", "mixed", "one second"])
def test_dedup_matches_definition(spark, limit, case):
    rng = random.Random(case)
    rows = {
        "edges": [("i", 0, 1, 5), ("i", 299, 2, 5), ("i", 300, 3, 5), ("i", 599, 4, 5), ("i", 600, 5, 5), ("i", 601, 6, 6),
                  ("i", 602, 7, 5), ("j", 602, 8, 5)],
        # one price for ever, a tick every few seconds: a single run over all partitions
        "constant": [("hot", 7 * i + rng.randrange(7), i, 100) for i in range(800)],
        "mixed": [(rng.choice(["hot", "hot", "x", "y"]), rng.randrange(40_000), i, rng.choice([1, 1, 1, 2]))
                  for i in range(900)],
        "one second": [("hot", i // 40, i, rng.choice([1, 2])) for i in range(400)],
    }[case]
    df = spark.createDataFrame(rows, TICKS)
    got = {r.id for r in D.dedup_ticks(df, window_s=300, limit=limit).collect()}
    assert got == greedy(rows, 300)


def test_dropped_tick_does_not_move_the_reference(spark):
    # 250 is dropped; 310 is 60 s after it but 310 s after the accepted one
    df = spark.createDataFrame([("i", 0, 1, 5), ("i", 250, 2, 5), ("i", 310, 3, 5)], TICKS)
    assert sorted(r.id for r in D.dedup_ticks(df).collect()) == [1, 3]


def test_dedup_keeps_other_columns(spark):
    schema = T.StructType.fromDDL(f"{TICKS}, stickers ARRAY<STRUCT<name: STRING>>, at TIMESTAMP")
    df = spark.createDataFrame([("i", 0, 1, 5, [("s",)], None)], schema)
    row = D.flag_duplicates(df).first()
    assert (row.stickers[0].name, row.is_duplicate) == ("s", False)


def test_carry_over_any_batch_size():
    rng = random.Random(5)
    rows = sorted((rng.choice("ab"), rng.randrange(5000), i, rng.choice([1, 1, 2])) for i in range(500))
    keys, seconds, ids, prices = (np.array(c) for c in zip(*rows))
    for size in (1, 2, 7, 500):
        carry, kept = None, set()
        for i in range(0, len(rows), size):
            part = slice(i, i + size)
            accepted, carry = D.accept(keys[part], prices[part], seconds[part], 300, carry)
            kept |= set(ids[part][accepted].tolist())
        assert kept == greedy(rows, 300)


@pytest.mark.parametrize("limit", [10_000, 30])
def test_accepted_windows_match_definition(spark, limit):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "x"]), rng.randrange(20_000), i, rng.randrange(90, 110)) for i in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {r.id: (r.n, r.sx, r.sxx) for r in D.accepted_windows(spark.createDataFrame(rows, TICKS), limit=limit).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept, history = greedy(rows, 300), {}
    assert set(got) == kept
    for key, _, tick, price in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if tick in kept:
            before = history.setdefault(key, [])[-19:]
            assert got[tick] == (len(before), sum(before), sum(p * p for p in before))
            history[key].append(price)
