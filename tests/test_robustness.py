"""Runs that follow each other, values out of range, order within a stream, and what is left behind."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.operators import ingest as I
from tickscope.operators.anomaly import append_trades, detect_anomalies
from tickscope.session import at_most, ensure_checkpoint_dir, prepare_session, scratch_tables, stored
from tickscope.sources import history as H
from tickscope.sources import listings as L
from tickscope.streaming.hot_path import windowed_ticks
from tickscope.streaming.ingest_stream import ingest_epoch

TICKS = f"id BIGINT, market_hash_name STRING, price_cents BIGINT, timestamp BIGINT, float_value DOUBLE, stickers {schemas.STICKERS}"
NAMED = "id BIGINT, source STRING, market_hash_name STRING, price_cents BIGINT, timestamp BIGINT"

def now():
    return F.expr("TIMESTAMP '2024-02-01 00:00:00'")



def batches_of(spark, ids):
    ticks = spark.createDataFrame([(i, "s", f"item {i % 3}", 100 + i, 1000 + i) for i in ids], NAMED)
    return I.chunk_batches(ticks, 2).withColumn("pos", F.col("chunk"))


def statuses(result):
    return sorted(r.status for r in result.statuses.collect())


def test_two_runs_share_a_ledger(spark):
    items = spark.createDataFrame([], schemas.MARKET_ITEMS)
    first = I.ingest_tick_batches(batches_of(spark, [1, 2, 3, 4]), items, spark.createDataFrame([], schemas.INGESTION_BATCHES), now())
    ledger = stored(first.ledger)
    second = I.ingest_tick_batches(batches_of(spark, [5, 6, 7, 8]), stored(first.items), ledger, now())
    assert statuses(first) == statuses(second) == ["SUCCESS"] * 2
    assert first.ticks.count() == second.ticks.count() == 4
    known = stored(ledger.unionByName(second.ledger))
    for ids in ([1, 2, 3, 4], [5, 6, 7, 8]):
        again = I.ingest_tick_batches(batches_of(spark, ids), items, known, now())
        assert statuses(again) == ["DUPLICATE"] * 2 and again.ticks.count() == 0


HISTORY = "name STRING, `unix timestamp` STRING, price STRING, quantity STRING, file_name STRING"


@pytest.mark.parametrize("cells,kept", [
    (("1700000000", "1e30", "3"), False), (("1700000000", "10.5", "1e30"), False), (("1700000000000", "10.5", "3"), False),
    (("9223372037", "10.5", "3"), False), (("9223372036", "10.5", "3"), True), (("-9223372036", "10.5", "3"), True),
    (("1e300", "10.5", "3"), False), (("1700000000", "10.5", "3"), True), (("garbage", "10.5", "1e30"), None),
])
def test_numbers_out_of_range_spoil_their_file_only(spark, cells, kept):
    rows = [("name", "unix timestamp", "price", "quantity", f) for f in ("a.csv", "b.csv")]
    raw = spark.createDataFrame([*rows, ("a", *cells, "a.csv"), ("b", "1700000000", "1.0", "1", "b.csv")], HISTORY)
    load = H.load_history(H.with_identity(H.mark_headers(raw)))
    found = {r.file_name for r in load.accepted.collect()}
    assert found == ({"a.csv", "b.csv"} if kept else {"b.csv"})
    assert {r.file_name for r in load.rejected_files.collect()} == ({"a.csv"} if kept is False else set())


def test_columns_are_addressed_by_name(spark, tmp_path):
    (tmp_path / "usual.csv").write_text("name,unix timestamp,price,quantity\na,1700000000,1.5,2\n")
    (tmp_path / "moved.csv").write_text("extra,quantity,price,name,unix timestamp\nx,3,2.5,b,1700000060\n")
    (tmp_path / "lacking.csv").write_text("name,price,quantity\nc,1.0,1\n")
    load = H.load_history(H.read_history_csv(spark, str(tmp_path)))
    rows = {r.file_name: (r.median_price_cents, r.volume_sold) for r in load.accepted.collect()}
    assert rows == {"usual.csv": (150, 2), "moved.csv": (250, 3)}
    assert [r.file_name for r in load.rejected_files.collect()] == ["lacking.csv"]


def test_ticks_out_of_range_are_set_aside(spark):
    raw = spark.createDataFrame([("a", 1e30, 1), ("b", 2.5, 1)], "market_hash_name STRING, price_usd DOUBLE, timestamp BIGINT")
    split = I.validate_ticks(raw, F.lit(5))
    assert [r.market_hash_name for r in split.good.collect()] == ["b"]
    assert [r.error for r in split.bad.collect()] == ["price is out of range"]
    entries = spark.createDataFrame([("a", "1e30", None), ("b", "2.5", None)], "market_hash_name STRING, p STRING, version STRING")
    priced = entries.withColumn("min_price", F.col("p").cast("double"))
    assert [r.market_hash_name for r in L.snapshot_ticks(priced, F.lit(0)).collect()] == ["b"]


@pytest.mark.parametrize("rows_per_batch", [100, 10_000])
def test_stream_order_does_not_depend_on_arrow_batches(spark, tmp_path, rows_per_batch):
    rng = random.Random(4)
    rows = [(i, "hot", rng.randint(1, 50), 1_000 + i * 400, None, []) for i in range(1500)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, TICKS).coalesce(1).write.parquet(str(tmp_path / "in"))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, rows_per_batch)
    try:
        name = f"ordered_{rows_per_batch}"
        stream = spark.readStream.schema(TICKS).parquet(str(tmp_path / "in"))
        (windowed_ticks(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(setting, before)
    prices = [p for _, _, p, _, _, _ in sorted(rows)]
    got = {r.id: r for r in spark.table(name).collect()}
    for i in range(1500):
        window = prices[max(0, i - 19):i]
        assert (got[i].newest_cents, got[i].sx) == (prices[i], sum(window))


def test_trades_name_new_items(spark):
    ticks = spark.createDataFrame([(i, f"item {i % 2}", 1000, 1000 * i, None, []) for i in range(1, 30)] + [
        (90 + k, f"item {k}", 100, 40_000 + k, None, []) for k in range(2)], TICKS)
    baselines = spark.createDataFrame([(f"item {k}", 900, 1000, 1000, 20, 0.0, 0.02, "{}") for k in range(2)], schemas.PUBLISHED_BASELINES)
    decisions = detect_anomalies(ticks, baselines, spark.createDataFrame([], schemas.STICKER_PRICES))
    items = spark.createDataFrame([(7, "item 0", "Weapon Skin", None)], schemas.MARKET_ITEMS)
    log = append_trades(decisions, items)
    assert {r.id: r.item_id for r in log.trades.collect()} == {"90": 7, "91": 8}
    assert {r.market_hash_name: r.id for r in log.items.collect()} == {"item 0": 7, "item 1": 8}


def test_streams_leave_no_scratch_tables(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    batch = batches_of(spark, [1, 2, 3, 4])
    records = batch.select(F.lit("p").alias("source_stream"), F.concat(F.col("chunk").cast("string"), F.lit("-0")).alias("record_id"),
                           F.to_json(F.struct("batch_id", "source", "ticks")).alias("payload"))
    items = spark.createDataFrame([], schemas.MARKET_ITEMS)
    for epoch in range(3):
        ingest_epoch(records, epoch, str(tmp_path), items)
    assert spark.read.parquet(f"{tmp_path}/ticks").count() == 4
    assert [r.status for r in spark.read.parquet(f"{tmp_path}/statuses").where("epoch = 2").collect()] == ["DUPLICATE"] * 2
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before
    with scratch_tables(spark):
        assert stored(spark.range(2)).count() == 2
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def test_record_order_and_size_checks_gather_no_rows(spark):
    records = spark.createDataFrame([("5-1", "x"), ("5-0", "y"), ("30-0", "z")], "record_id STRING, payload STRING")
    ordered = I.in_record_order(records)
    text = ordered._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "Exchange" not in text
    assert [r.payload for r in ordered.orderBy("pos").collect()] == ["y", "x", "z"]
    wide = spark.range(10).select("id", F.repeat(F.lit("t"), 1000).alias("text"))
    assert at_most(wide, 10, 20_000) and not at_most(wide, 10, 5_000) and not at_most(wide, 9, 20_000)


def test_the_planner_broadcasts_by_measured_sizes(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, value in zip(keys, ("10m", None)):
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
        names = F.concat(F.lit("★ a name of some length that files compress well | brand-"), F.col("id").cast("string"))
        table = stored(spark.range(200_000).select(names.alias("name")))
        few = stored(spark.range(50).select(names.alias("name")))
        prepare_session(spark)
        assert spark.conf.get(keys[1]) == str(10 << 20)
        for found, rows, broadcast in ((table, 0, False), (few, 199_950, True)):
            joined = table.join(found, "name", "left_anti")
            assert joined.count() == rows
            kept = joined.groupBy().count()
            kept.collect()
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == broadcast
        spark.conf.set(keys[0], "-1")
        prepare_session(spark)
        assert spark.conf.get(keys[0]) == "-1"
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
