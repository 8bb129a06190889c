import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.operators import ingest as I
from tickscope.sources import listings as L

ID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def now():
    return F.expr("TIMESTAMP '2024-02-01 00:00:00'")


BATCHES = f"pos BIGINT, batch_id STRING, source STRING, ticks {schemas.BATCH_TICKS}"
TWO = [("AK", 1500, 1700000000), ("M4", 900, 1700000060)]


@pytest.fixture
def empty(spark):
    return (spark.createDataFrame([], schemas.MARKET_ITEMS), spark.createDataFrame([], schemas.INGESTION_BATCHES))


def statuses(spark, rows, ledger):
    found = I.classify_batches(spark.createDataFrame(rows, BATCHES), ledger).collect()
    return {r.pos: r.status for r in found}


def test_statuses(spark, empty):
    raised = [("AK", 1600, 1700000000), TWO[1]]
    other = "1f8fad5b-d9cb-469f-a165-70867728950e"
    rows = [
        (1, ID, "s", TWO), (2, ID, "s", TWO), (3, ID, "s", raised), (4, ID.upper(), "s", TWO),
        (5, ID.replace("-", ""), "t", TWO), (6, None, "s", TWO), (7, None, "s", []), (8, other, "s", []),
        (9, other, "s", []), (10, "no-uuid", "s", TWO), (11, None, " ", TWO), (12, None, "s", [("AK", 0, 1)]),
        (13, None, "s", [(None, 5, 1)]), (14, None, "s", None), (15, None, "s", [("AK", 5, None)]),
    ]
    assert statuses(spark, rows, empty[1]) == {
        1: "SUCCESS", 2: "DUPLICATE", 3: "CONFLICT", 4: "DUPLICATE", 5: "CONFLICT", 6: "SUCCESS", 7: "SKIPPED",
        8: "SKIPPED", 9: "DUPLICATE", **{n: "REJECTED" for n in range(10, 16)},
    }


def test_ingest_then_replay_is_a_duplicate(spark, empty):
    items, ledger = empty
    known = items.unionByName(spark.createDataFrame([(7, "M4", "Agent", None)], schemas.MARKET_ITEMS))
    batches = spark.createDataFrame([(1, ID, "venue", TWO)], BATCHES)
    first = I.ingest_tick_batches(batches, known, ledger, now())
    stored = sorted((r.item_id, r.price_cents, r.marketplace_source, r.inserted_at) for r in first.ticks.collect())
    assert stored == [(7, 900, "venue", datetime(2023, 11, 14, 22, 14, 20)), (8, 1500, "venue", datetime(2023, 11, 14, 22, 13, 20))]
    assert {r.market_hash_name: r.id for r in first.items.collect()} == {"M4": 7, "AK": 8}
    assert [(r.batch_id, r.record_count) for r in first.ledger.collect()] == [(ID, 2)]
    again = I.ingest_tick_batches(batches, first.items, first.ledger, now())
    assert [(r.status, r.records_processed) for r in again.statuses.collect()] == [("DUPLICATE", 0)]
    assert again.ticks.count() == 0 and again.ledger.count() == 0
    changed = spark.createDataFrame([(1, ID, "venue", [("AK", 1600, 1700000000), TWO[1]])], BATCHES)
    assert statuses(spark, changed.collect(), first.ledger) == {1: "CONFLICT"}


def test_upsert_items_updates_the_type_only_of_seen_names(spark):
    items = spark.createDataFrame([(1, "Clutch Case", "Old", "r"), (2, "Other Case", "Old", None)], schemas.MARKET_ITEMS)
    names = spark.createDataFrame([("Clutch Case",), ("B",), ("A",), ("A",)], "market_hash_name STRING")
    for limit in (1000, 1):
        rows = {r.market_hash_name: (r.id, r.item_type, r.rarity) for r in I.upsert_items(names, items, limit).collect()}
        assert rows == {"Clutch Case": (1, "Container/Collectible", "r"), "Other Case": (2, "Old", None),
                        "A": (3, "Agent", None), "B": (4, "Agent", None)}


def record(name, payload):
    return ("pending", name, payload if payload is None or isinstance(payload, str) else json.dumps(payload))


GOOD = {"batch_id": ID, "source": "s", "ticks": [{"market_hash_name": "AK", "price_cents": 5, "timestamp": 1}]}


def test_malformed_records_do_not_block_good_ones(spark):
    rows = [
        record("1-0", GOOD), record("2-0", "[1]"), record("3-0", "{not json"), record("4-0", None),
        record("5-0", {**GOOD, "batch_id": 5}), record("6-0", {**GOOD, "batch_id": "x"}), record("7-0", {**GOOD, "source": " "}),
        record("8-0", {**GOOD, "ticks": [1]}), record("9-0", {**GOOD, "ticks": "none"}), record("10-0", {"source": "s"}),
        record("11-0", {**GOOD, "ticks": []}), record("12-0", {**GOOD, "batch_id": ""}), record("13-0", "7"),
        record("14-0", {**GOOD, "ticks": [GOOD["ticks"][0], 3]}), record("15-0", {**GOOD, "source": 3}),
    ]
    raw = spark.createDataFrame(rows, "source_stream STRING, record_id STRING, payload STRING")
    split = I.split_malformed(raw)
    assert {r.record_id for r in split.valid.collect()} == {"1-0", "11-0"}
    bad = {r.record_id: r.last_error for r in split.quarantine.collect()}
    assert set(bad) == {f"{n}-0" for n in range(1, 16)} - {"1-0", "11-0"}
    assert all(0 < len(e) <= 500 for e in bad.values())
    assert bad["2-0"] == "payload must be a JSON object" and bad["3-0"] == "payload is not valid JSON"


def test_replay_limit_counts_attempts(spark, empty):
    items, ledger = empty
    conflict = {**GOOD, "ticks": [{"market_hash_name": "AK", "price_cents": 6, "timestamp": 1}]}
    rows = [record("10-0", GOOD), record("9-1", GOOD), record("9-0", GOOD), record("11-0", conflict), record("100-0", GOOD)]
    dead = spark.createDataFrame(rows, "source_stream STRING, record_id STRING, payload STRING")
    replay = I.replay_dead_letters(dead, items, ledger, 4, now())
    assert tuple(replay.summary.first()) == (4, 3, 1)
    assert {r.record_id for r in replay.remaining.collect()} == {"11-0", "100-0"}
    assert replay.ingest.ticks.count() == 1
    with pytest.raises(ValueError):
        I.replay_dead_letters(dead, items, ledger, 0, now())


@pytest.mark.parametrize("limit", [1000, 3])
def test_chunks_are_stable_and_whole(spark, limit):
    rows = [(i, "s" if i % 4 else "t", f"n{i}", i, 1000 - i) for i in range(50)]
    ticks = spark.createDataFrame(rows, "id BIGINT, source STRING, market_hash_name STRING, price_cents BIGINT, timestamp BIGINT")
    one = {r.batch_id: r for r in I.chunk_batches(ticks, 8, limit).collect()}
    two = {r.batch_id: r for r in I.chunk_batches(ticks.repartition(5), 8, 1000).collect()}
    assert one == two
    sizes = sorted(len(r.ticks) for r in one.values())
    assert sum(sizes) == 50 and max(sizes) == 8
    assert all(len(b) == 36 for b in one)
    first = next(r for r in one.values() if r.source == "s" and r.chunk == 0)
    assert [t.timestamp for t in first.ticks] == sorted(t.timestamp for t in first.ticks)


def test_validate_ticks(spark):
    rows = [("a", 0.125, None), ("b", 0.0, 5), (None, 1.0, 5), ("c", None, 5), ("d", float("nan"), 5), ("e", -1.0, 5), ("f", 2.0, 7)]
    split = I.validate_ticks(spark.createDataFrame(rows, "market_hash_name STRING, price_usd DOUBLE, timestamp BIGINT"), F.lit(99))
    assert {(r.market_hash_name, r.price_cents, r.timestamp) for r in split.good.collect()} == {("a", 12, 99), ("f", 200, 7)}
    assert split.bad.count() == 5


def test_non_blank(value):
    assert value(I.non_blank(F.lit(" x "))) is True
    assert value(I.non_blank(F.lit(" \t"))) is False
    assert value(I.non_blank(F.lit(None).cast("string"))) is False


def test_snapshot(spark, tmp_path):
    (tmp_path / "snap.json").write_text(json.dumps([
        {"market_hash_name": "AK-47 | Redline (Field-Tested)", "min_price": 15.5, "version": None},
        {"market_hash_name": "★ Bayonet | Doppler (Factory New)", "min_price": 700.0, "version": "Phase 3"},
        {"market_hash_name": "No price", "min_price": None},
    ]))
    rows = L.read_listing_snapshot(spark, str(tmp_path), F.lit(42)).collect()
    assert {(r.market_hash_name, r.price_cents, r.timestamp) for r in rows} == {
        ("AK-47 | Redline (Field-Tested)", 1550, 42), ("★ Bayonet | Doppler (Phase 3) (Factory New)", 70000, 42)}


MESSAGES = [
    {"eventType": "listed", "sales": [
        {"marketHashName": "★ Bayonet | Doppler (Factory New)", "salePrice": 155000, "wear": 0.31, "version": "Ruby",
         "stickers": [{"name": "Titan", "slot": 1}]},
        {"marketHashName": "", "salePrice": 1}, {"salePrice": 5}, {"marketHashName": "No price"}]},
    {"eventType": "sold", "sales": [{"marketHashName": "x", "salePrice": 5}]},
    {"sales": [{"marketHashName": "relayed", "salePrice": 250}]},
]


def test_listing_messages(spark, tmp_path):
    (tmp_path / "m.txt").write_text("\n".join([*map(json.dumps, MESSAGES), "{not valid json"]))
    messages = spark.read.text(str(tmp_path))
    row, = L.listing_ticks(messages, F.lit(1)).collect()
    assert (row.market_hash_name, row.price_usd, row.price_cents) == ("★ Bayonet | Doppler (Ruby) (Factory New)", 1550.0, 155000)
    assert (row.float_value, row.stickers[0].name) == (0.31, "Titan")
    everything = {r.market_hash_name for r in L.listing_ticks(messages, F.lit(1), raw_feed=False).collect()}
    assert {"relayed", "x"} < everything
    stream = L.read_listing_stream(spark, str(tmp_path), F.lit(1), files_per_trigger=1)
    query = stream.writeStream.format("memory").queryName("listings").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.price_cents for r in spark.table("listings").collect()] == [155000]
