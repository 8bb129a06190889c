"""Tick stream to decisions and paper trades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickscope import schemas
from tickscope.functions.scoring import DEFAULTS, Tuning
from tickscope.operators.anomaly import append_trades, judge, with_baseline, with_score
from tickscope.operators.ingest import chunk_batches
from tickscope.session import scratch_tables
from tickscope.sources.tables import epochs_before
from tickscope.streaming.ingest_stream import ingest_epoch
from tickscope.streaming.processor import OUTPUT, TickProcessor

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def windowed_ticks(ticks: DataFrame, tuning: Tuning = DEFAULTS) -> DataFrame:
    """Stream of ticks with ``is_duplicate`` and, when accepted, the moments of their window."""
    use_rocksdb(ticks.sparkSession)
    slim = ticks.select("id", "market_hash_name", "price_cents", "timestamp", "float_value",
                        F.to_json("stickers").alias("stickers_json"))
    return slim.groupBy("market_hash_name").transformWithStateInPandas(
        statefulProcessor=TickProcessor(tuning), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def decide(flagged: DataFrame, baselines: DataFrame, stickers: DataFrame, tuning: Tuning = DEFAULTS) -> DataFrame:
    """Decisions of one micro-batch; the same columns as the batch job gives."""
    accepted = flagged.filter(~F.col("is_duplicate")).withColumn(
        "stickers", F.from_json("stickers_json", schemas.STICKERS)
    )
    scored = with_score(with_baseline(accepted, baselines), tuning, price="newest_cents")
    return judge(scored, stickers, tuning)


def start_hot_path(
    ticks: DataFrame,
    lookups: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    out: str,
    checkpoint: str,
    tuning: Tuning = DEFAULTS,
    available_now: bool = False,
    deliver: tuple[str, str] | None = None,
) -> StreamingQuery:
    """Run the hot path into ``out``/ticks, /decisions, /trades and /items (all items after a micro-batch
    whose trades named new ones).

    ``deliver`` is (source, root): the accepted ticks of each micro-batch are also chunked under this source and
    ingested into the tables below ``root``, once each.

    ``lookups`` returns (items, published baselines, sticker prices) and is called for every
    micro-batch, so a refreshed table is used from the next one on. Every output folder is
    keyed by the micro-batch and overwritten when it runs again, so a restart repeats nothing.
    """
    def write(df: DataFrame, name: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")

    def process(flagged: DataFrame, epoch: int) -> None:
        items, baselines, stickers = lookups()
        spark = flagged.sparkSession
        for known in epochs_before(spark, f"{out}/items", epoch)[-1:]:
            named = spark.read.schema(schemas.MARKET_ITEMS).parquet(f"{out}/items/epoch={known}")
            items = named.unionByName(items.join(named, "market_hash_name", "left_anti").select(*named.columns))
        # stored first, then read back: the stateful operator must run once per micro-batch
        write(flagged, "ticks", epoch)
        with scratch_tables(spark):
            stored = spark.read.schema(OUTPUT).parquet(f"{out}/ticks/epoch={epoch}")
            write(decide(stored, baselines, stickers, tuning), "decisions", epoch)
            log = append_trades(spark.read.parquet(f"{out}/decisions/epoch={epoch}"), items)
            write(log.trades, "trades", epoch)
            write(log.items, "items", epoch)
        if deliver is not None:
            source, root = deliver
            accepted = spark.read.schema(OUTPUT).parquet(f"{out}/ticks/epoch={epoch}").filter(~F.col("is_duplicate"))
            batches = chunk_batches(accepted.withColumn("source", F.lit(source)))
            records = batches.select(
                F.lit("hot-path").alias("source_stream"), F.concat(F.lit(f"{epoch}-"), F.col("chunk").cast("string")).alias("record_id"),
                F.to_json(F.struct("batch_id", "source", "ticks")).alias("payload"),
            )
            ingest_epoch(records, epoch, root, items)

    writer = windowed_ticks(ticks, tuning).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
