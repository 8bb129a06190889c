"""Exactly-once ingest of a stream of batch payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickscope import schemas
from tickscope.operators.ingest import canonical_uuid, in_record_order, ingest_tick_batches, split_malformed, with_changes
from tickscope.session import scratch_tables
from tickscope.sources.runs import append_run, compact_runs, read_runs

ENVELOPE = (
    f"source_stream STRING, record_id STRING, payload STRING, batch_id STRING, source STRING, "
    f"ticks {schemas.BATCH_TICKS}, pos STRUCT<ms: BIGINT, seq: BIGINT, record_id: STRING>"
)


def _ledger_part(batch_id: str):
    """The first two digits of the canonical id: 256 parts, at most."""
    return F.substring(canonical_uuid(F.col(batch_id)), 1, 2).alias("part")


def newest_items(rows: DataFrame) -> DataFrame:
    """One row per id and name of an item log: the one of the latest run."""
    newest = rows.groupBy("id", "market_hash_name").agg(F.max_by(F.struct("item_type", "rarity"), "run_last").alias("_v"))
    return newest.select("id", "market_hash_name", "_v.item_type", "_v.rarity")


def known_items(spark: SparkSession, root: str, epoch: int, first_items: DataFrame) -> DataFrame:
    """All items before micro-batch ``epoch``: ``first_items`` with the changes that earlier micro-batches logged."""
    return with_changes(first_items, newest_items(read_runs(spark, f"{root}/items", epoch, schemas.MARKET_ITEMS)))


def ingest_epoch(records: DataFrame, epoch: int, root: str, first_items: DataFrame) -> None:
    """Ingest one micro-batch of records (source_stream, record_id, payload).

    Only what earlier micro-batches wrote counts as known, and each output of this one goes to
    its own folder, so running it again after a crash gives the same tables. The ledger is
    written last: an epoch without a committed ledger is not known. Ledger and items are logs whose runs are merged now and then; a
    micro-batch writes its own batches and the items it adds or changes.
    """
    spark = records.sparkSession

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{name}/epoch={epoch}")

    with scratch_tables(spark):
        compact_runs(spark, f"{root}/ledger", epoch, schemas.INGESTION_BATCHES, "part")
        compact_runs(spark, f"{root}/items", epoch, schemas.MARKET_ITEMS, merge=newest_items)
        ledger = read_runs(spark, f"{root}/ledger", epoch, schemas.INGESTION_BATCHES, "part")
        items = known_items(spark, root, epoch, first_items)
        split = split_malformed(records)
        write(split.quarantine, "quarantine")
        write(in_record_order(split.valid), "batches")
        batches = spark.read.schema(ENVELOPE).parquet(f"{root}/batches/epoch={epoch}")
        # only the parts of the ledger that can know these batches are read
        parts = [r.part for r in batches.select(_ledger_part("batch_id")).distinct().collect()]
        known = ledger.filter(F.col("part").isin(parts)).drop("part", "run_last")
        result = ingest_tick_batches(batches, items, known, F.current_timestamp())
        append_run(result.changed_items, f"{root}/items", epoch)
        write(result.ticks, "ticks")
        write(result.statuses, "statuses")
        append_run(result.ledger.withColumn("part", _ledger_part("batch_id")), f"{root}/ledger", epoch, "part")


def start_ingest(
    records: DataFrame, first_items: DataFrame, root: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    writer = records.writeStream.foreachBatch(
        lambda df, epoch: ingest_epoch(df, epoch, root, first_items)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
