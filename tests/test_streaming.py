import json
import random
import weakref

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.operators import monitoring as M
from tickscope.operators.anomaly import detect_anomalies
from tickscope.streaming.hot_path import start_hot_path, windowed_ticks
from tickscope.streaming.ingest_stream import ingest_epoch, known_items, start_ingest
from tickscope.streaming.processor import TickProcessor, ordered

TICKS = f"id BIGINT, market_hash_name STRING, price_cents BIGINT, timestamp BIGINT, float_value DOUBLE, stickers {schemas.STICKERS}"


def write_ticks(spark, path, batches):
    """One file per list of ticks, in arrival order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(f"{path}/file={i}")


def stream_of(spark, path):
    return (spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
            .option("latestFirst", False).parquet(path))


def collect_states(spark, path, tmp_path, name):
    query = (windowed_ticks(stream_of(spark, path)).writeStream.format("memory").queryName(name)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    return {r.id: r for r in spark.table(name).collect()}


def tick(number, price, second, name="i", stickers=()):
    return (number, name, price, second, None, [(s,) for s in stickers])


def test_dedup_state_across_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    write_ticks(spark, path, [
        [tick(1, 5, 1000)], [tick(2, 5, 1299)], [tick(3, 5, 1300)],
        # late with an equal price: dropped; late with another price: accepted, and now the reference
        [tick(4, 5, 900)], [tick(5, 6, 800)], [tick(6, 5, 1310)],
    ])
    got = collect_states(spark, path, tmp_path, "dedup_state")
    assert {i: r.is_duplicate for i, r in got.items()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_window_keeps_the_newest_twenty(spark, tmp_path):
    path = str(tmp_path / "in")
    write_ticks(spark, path, [
        [tick(i, 100 + i, 1000 * i) for i in range(1, 22)],
        [tick(50, 7, 500)],        # older than all twenty: evicted at once
        [tick(51, 99, 21500), tick(52, 1000, 21500)],
    ])
    got = collect_states(spark, path, tmp_path, "window_state")
    assert (got[1].n, got[1].newest_cents) == (0, 101)
    assert (got[20].n, got[21].n) == (19, 19)
    assert got[21].sx == sum(100 + i for i in range(2, 21))
    assert (got[50].newest_cents, got[50].n) == (121, 19)
    # "21500:1000" sorts before "21500:99" as text, so 99 stays the newest price
    assert (got[51].newest_cents, got[52].newest_cents) == (99, 99)


@pytest.fixture
def lookups(spark):
    names = [f"n{i}" for i in range(6)]
    items = spark.createDataFrame([(i, n, "Agent", None) for i, n in enumerate(names)], schemas.MARKET_ITEMS)
    rows = [(n, 60 + i, 100, 100, 12, 0.5, 0.12) for i, n in enumerate(names[:5])]
    baselines = spark.createDataFrame(
        rows, "market_hash_name STRING, support_floor_cents BIGINT, latest_price_cents BIGINT, "
              "rolling_30d_avg_cents BIGINT, volatility_cents BIGINT, drift_percent DOUBLE, cv_published DOUBLE")
    stickers = spark.createDataFrame([("Titan", "500000"), ("odd", "n/a")], "name STRING, price STRING")
    return items, baselines, stickers


def random_batches(seed, files=4, per_file=120):
    rng, second, out = random.Random(seed), 0, []
    for f in range(files):
        rows = []
        for i in range(per_file):
            second += rng.randrange(1, 120)
            price = rng.choice([100, 100, 100, 101, 99, 40, 170])
            stickers = rng.choice([(), (), ("Titan", "odd")])
            rows.append(tick(f * 1000 + i, price * rng.choice([1, 1, 1, 10]), second, f"n{rng.randrange(6)}", stickers))
        out.append(rows)
    return out


def test_stream_equals_batch(spark, tmp_path, lookups):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = random_batches(4)
    write_ticks(spark, path, batches)
    start_hot_path(stream_of(spark, path), lambda: lookups, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    columns = ["id", "z_score", "mean_cents", "source", "sticker_value_cents", "approved", "reason", "estimated_profit_cents"]
    streamed = spark.read.parquet(f"{out}/decisions").select(columns).collect()
    _, baselines, stickers = lookups
    batch = detect_anomalies(spark.createDataFrame([r for b in batches for r in b], TICKS), baselines, stickers)
    assert sorted(streamed) == sorted(batch.select(columns).collect())
    assert len({r.source for r in streamed}) == 3 and len({r.approved for r in streamed}) == 2
    trades = spark.read.parquet(f"{out}/trades")
    assert trades.count() == sum(r.approved for r in streamed)
    assert trades.filter("item_id IS NULL").count() == 0
    # a second start finds nothing new
    start_hot_path(stream_of(spark, path), lambda: lookups, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert spark.read.parquet(f"{out}/trades").count() == trades.count()


def payload(batch_id, price, name="AK"):
    return json.dumps({"batch_id": batch_id, "source": "s", "ticks": [{"market_hash_name": name, "price_cents": price, "timestamp": 1}]})


IDS = [f"0f8fad5b-d9cb-469f-a165-7086772895{i:02d}" for i in range(10)]
RECORD = "source_stream STRING, record_id STRING, payload STRING"


def test_ingest_stream(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [[payload(IDS[0], 5), payload(IDS[1], 6, "M4")], [payload(IDS[0], 5), payload(IDS[2], 7)], ["{broken", payload(IDS[1], 9)]]
    for i, file in enumerate(rows):
        records = [("pending", f"{i}-{j}", text) for j, text in enumerate(file)]
        spark.createDataFrame(records, RECORD).coalesce(1).write.mode("append").json(f"{path}/file={i}")
    stream = (spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(path))
    no_items = spark.createDataFrame([], schemas.MARKET_ITEMS)
    start_ingest(stream, no_items, root, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted(r.price_cents for r in spark.read.parquet(f"{root}/ticks").collect()) == [5, 6, 7]
    counts = {r.status: r["count"] for r in spark.read.parquet(f"{root}/statuses").groupBy("status").count().collect()}
    assert counts == {"SUCCESS": 3, "DUPLICATE": 1, "CONFLICT": 1}
    assert spark.read.parquet(f"{root}/quarantine").count() == 1
    assert {(r.id, r.market_hash_name) for r in known_items(spark, root, 99, no_items).collect()} == {(1, "AK"), (2, "M4")}


def test_ingest_epoch_can_run_again(spark, tmp_path):
    root = str(tmp_path)
    no_items = spark.createDataFrame([], schemas.MARKET_ITEMS)
    records = spark.createDataFrame([("pending", "1-0", payload(IDS[0], 5))], RECORD)
    ingest_epoch(records, 0, root, no_items)
    ingest_epoch(records, 1, root, no_items)   # a replay in a later epoch
    ingest_epoch(records, 0, root, no_items)   # the first epoch again, as after a crash
    assert spark.read.parquet(f"{root}/ticks").count() == 1
    assert spark.read.parquet(f"{root}/ledger").count() == 1


@pytest.mark.parametrize("rates", [M.anomaly_rates, M.decision_rates, M.confirmation_rate, M.trade_rates])
def test_stream_rates_equal_batch_rates(spark, tmp_path, rates):
    path = str(tmp_path / "in")
    write_ticks(spark, path, [[tick(i, 5 + i, 25 * i) for i in range(20)], [tick(99, 5, 100_000)]])

    def prepared(df):
        return (df.withColumn("event_time", F.timestamp_seconds("timestamp")).withColumn("source", F.lit("local"))
                .withColumn("approved", F.col("id") % 3 == 0).withColumnRenamed("price_cents", "estimated_profit_cents"))

    streamed = rates(prepared(stream_of(spark, path)).withWatermark("event_time", "1 minute"))
    name = rates.__name__
    query = (streamed.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    batch = rates(prepared(spark.read.schema(TICKS).option("recursiveFileLookup", True).parquet(path)))
    closed = batch.filter(F.col("window_start") < F.timestamp_seconds(F.lit(90_000)))
    assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, closed.collect()))
    assert closed.count() > 5


def test_rates_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    write_ticks(spark, path, [[tick(1, 5, 0), tick(2, 6, 30)], [tick(3, 6, 61)], [tick(4, 6, 1000)]])
    flagged = stream_of(spark, path).withColumn("is_duplicate", F.col("id") == 2)
    timed = flagged.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", "10 seconds")
    query = (M.tick_rates(timed).writeStream.format("memory").queryName("rates").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.table("rates").orderBy("window_start").collect()
    assert [(r.processed_per_s, r.deduplicated_per_s) for r in rows[:2]] == [(1 / 60, 1 / 60), (1 / 60, 0.0)]


class Value:
    """A value state without a store."""

    def __init__(self):
        self.kept = None

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def update(self, kept):
        self.kept = kept

    def getValueState(self, name, schema):
        return Value()


def hot_item(count, size):
    rng = random.Random(8)
    rows = [(i, "i", rng.choice([5, 6, 7]), 40 * rng.randrange(count * size), None, None) for i in range(count * size)]
    columns = ["id", "market_hash_name", "price_cents", "timestamp", "float_value", "stickers_json"]
    return [pd.DataFrame(rows[k:k + size], columns=columns) for k in range(0, len(rows), size)]


def test_a_hot_item_is_not_held_in_memory():
    refs, most = [], 0

    def arriving():
        nonlocal most
        for frame in hot_item(120, 50):
            piece = frame.copy()
            refs.append(weakref.ref(piece))
            most = max(most, sum(r() is not None for r in refs))
            yield piece
            del piece

    processor = TickProcessor()
    processor.run_rows = 500
    processor.init(Value())
    got = pd.concat(processor.handleInputRows(("i",), arriving(), None))
    assert most <= 12 and len(got) == 6000
    whole = TickProcessor()
    whole.init(Value())
    want = pd.concat(whole.handleInputRows(("i",), iter(hot_item(120, 50)), None))
    assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()
    assert (processor._last.kept, processor._window.kept) == (whole._last.kept, whole._window.kept)


def test_runs_merge_in_levels():
    frames = hot_item(60, 10)
    want = pd.concat(frames).sort_values(["timestamp", "id"], kind="stable")["id"].tolist()
    for run_rows, fan in ((1, 2), (10, 3), (25, 2), (10_000, 2)):
        assert pd.concat(ordered(iter(frames), run_rows, fan))["id"].tolist() == want
    assert list(ordered(iter([]))) == []
