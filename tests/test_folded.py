import datetime
import random

from pyspark.sql import functions as F

from tickscope.operators import baselines as B
from tickscope.operators import monitoring as M
from tickscope.sources.runs import committed_runs

HISTORY = "item_id BIGINT, sale_date TIMESTAMP, median_price_cents BIGINT, volume_sold BIGINT, line BIGINT"
START = datetime.datetime(2024, 1, 1)


def history():
    """One item with most rows, one without prices, one with a single row; prices repeat, days tie."""
    rng, rows = random.Random(5), []
    for line in range(900):
        item = 1 if rng.random() < 0.7 else rng.choice([2, 3])
        price = None if rng.random() < 0.05 else rng.choice([100, 150, 151, 4000, 90_000])
        rows.append((item, START + datetime.timedelta(days=rng.randrange(200)), price, rng.choice([None, 1, 5]), line))
    rows += [(4, START, None, 2, 900), (5, START, 70, 1, 901)]
    return rows


def test_folded_refreshes_equal_one_pass(spark, tmp_path):
    rows = history()
    parts = [rows[:10], rows[10:500], [], rows[500:501], rows[501:]]
    for epoch, part in enumerate(parts):
        new = spark.createDataFrame(part, HISTORY).repartition(3)
        if epoch == 3:  # a refresh that is run twice counts once
            B.fold_history(spark, str(tmp_path), epoch, new, ["line"])
        found = B.fold_history(spark, str(tmp_path), epoch, new, ["line"])
    want = B.macro_baselines(spark.createDataFrame(rows, HISTORY), ["line"])
    assert found.columns == want.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert {r.item_id for r in found.collect()} == {1, 2, 3, 4, 5}


def test_folded_runs_are_merged(spark, tmp_path):
    for epoch in range(9):
        new = spark.createDataFrame([(1, START + datetime.timedelta(days=epoch), 100, 1, epoch)], HISTORY)
        found = B.fold_history(spark, str(tmp_path), epoch, new, ["line"])
    assert [(r.first, r.last) for r in committed_runs(spark, f"{tmp_path}/prices", 99)] == [(0, 7), (8, 8)]
    assert spark.read.parquet(f"{tmp_path}/prices.merged/run=0-7").collect()[0].times == 8
    assert [(r.total_points_analyzed, r.latest_price_cents) for r in found.collect()] == [(9, 100)]


def test_alerts_on_a_stream_equal_the_batch(spark, tmp_path):
    """A burst of two and a half minutes, twenty minutes of rejections with one gap, and a last tick that closes all windows."""
    seconds = [(s, True) for s in range(600, 750) for _ in range(1)] + [(60 * m, False) for m in range(100, 140) if m != 121] + [(90_000, True)]
    columns = "timestamp BIGINT, approved BOOLEAN"
    for part, rows in enumerate((seconds[:100], seconds[100:170], seconds[170:])):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/in/part={part}")
        stream = spark.readStream.schema(columns).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        timed = stream.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", "1 minute")
        (M.alerts_on_stream(timed).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination())
    whole = spark.createDataFrame(seconds, columns).withColumn("event_time", F.timestamp_seconds("timestamp")).withColumn("source", F.lit("s"))
    want = M.alerts(M.anomaly_rates(whole), M.confirmation_rate(whole)).filter(F.col("window_start") < F.timestamp_seconds(F.lit(89_000)))
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, found.select("window_start", "alert").collect())) == sorted(map(str, want.collect()))
    assert {r.alert for r in found.collect()} == {"high_anomaly_rate", "low_confirmation_rate"}
