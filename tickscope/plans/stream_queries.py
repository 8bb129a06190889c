"""Streaming jobs run to completion over the driver tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.functions.scoring import DEFAULTS
from tickscope.operators import monitoring as M
from tickscope.operators.dedup import flag_duplicates
from tickscope.operators.ingest import chunk_batches
from tickscope.plans.fixtures import SPLIT
from tickscope.plans.ingest_queries import CHUNK, CHUNKS, LISTED_COLUMNS, LISTED_SQL, listing_messages, ntz
from tickscope.plans.registry import Views, query
from tickscope.plans.tick_queries import DECIDE, DECISION_COLUMNS, DETECT, SLIDING, decisions, published, timed
from tickscope.session import ensure_checkpoint_dir, stored
from tickscope.sources import listings
from tickscope.sources.tables import epochs_before
from tickscope.streaming.carried import no_state, start_carried_path
from tickscope.streaming.hot_path import start_hot_path
from tickscope.streaming.ingest_stream import start_ingest


def scratch(v: Views) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(v.spark)
    return f"{v.spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4().hex}"


def live_stream(v: Views, deliver: bool = False) -> str:
    """Runs the hot path over the live ticks to the end; returns the folder of its outputs."""
    events = v.spark.readStream.schema(v.table("events").schema).parquet(f"{v.sf_dir}/events*.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    names = F.when(k % 10 == 0, F.array(k, F.floor(k / 2))).when(k % 5 == 0, F.array(k)).otherwise(F.array())
    ticks = events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("part_id"),
        F.rint(F.col("value") * 100).cast("bigint").alias("price_cents"),
        F.col("ts").cast("timestamp").alias("inserted_at"), (k.cast("double") / 100).alias("float_value"),
        F.transform(names, lambda n: F.struct(F.concat(F.lit("sticker-"), n.cast("string")).alias("name"))).alias("stickers"),
    ).filter((F.col("inserted_at") >= F.expr(SPLIT)) & (F.col("price_cents") > 0))
    named = ticks.join(v.parts.select("part_id", "market_hash_name"), "part_id").withColumn(
        "timestamp", F.unix_seconds("inserted_at")
    )
    baselines = published(v)
    root = scratch(v)
    running = start_hot_path(
        named, lambda: (v.items, baselines, v.sticker_prices), f"{root}/out", f"{root}/checkpoint", available_now=True,
        deliver=("live", f"{root}/ingest") if deliver else None,
    )
    running.awaitTermination()
    return root


@query("hot_path", f"WITH RECURSIVE {DECIDE} SELECT {DECISION_COLUMNS} FROM decisions")
def hot_path(v: Views) -> DataFrame:
    """Live ticks as a stream; the decisions equal those of the batch job."""
    return v.spark.read.parquet(f"{live_stream(v)}/out/decisions").select(*DECISION_COLUMNS.split(", "))


@query("hot_path_ingest", f"""
    WITH RECURSIVE {DECIDE}
    SELECT i.id AS item_id, a.price_cents, 'live' AS marketplace_source, make_timestamp(a.timestamp * 1000000) AS inserted_at
    FROM accepted AS a JOIN fx_items AS i ON i.market_hash_name = a.market_hash_name""")
def hot_path_ingest(v: Views) -> DataFrame:
    """What the hot path accepts is chunked and ingested."""
    ticks = v.spark.read.parquet(f"{live_stream(v, deliver=True)}/ingest/ticks")
    return ntz(ticks.select("item_id", "price_cents", "marketplace_source", "inserted_at"), "inserted_at")


@query("ingest_stream", f"""
    WITH {CHUNKS}, stored AS (
      SELECT batch_id, source, unnest(ticks) AS t FROM based
      WHERE NOT list_bool_or(list_transform(ticks, lambda t: t.price_cents <= 0)))
    SELECT batch_id, i.id AS item_id, t.price_cents AS price_cents, source AS marketplace_source,
           make_timestamp(t.timestamp * 1000000) AS inserted_at
    FROM stored JOIN fx_items AS i ON i.market_hash_name = t.market_hash_name""")
def ingest_stream(v: Views) -> DataFrame:
    """Every batch is sent twice and stored once."""
    root = scratch(v)
    batches = chunk_batches(v.named_ticks.withColumn("source", F.col("marketplace_source")), CHUNK)
    records = batches.select(
        F.lit("pending").alias("source_stream"), F.concat_ws("-", "source", "chunk").alias("record_id"),
        F.to_json(F.struct("batch_id", "source", "ticks")).alias("payload"),
    )
    again = records.withColumn("record_id", F.concat("record_id", F.lit("-again")))
    for name, rows in (("first", records), ("second", again)):
        rows.write.parquet(f"{root}/in/{name}")
    arrivals = v.spark.readStream.schema(records.schema).option("recursiveFileLookup", True).parquet(f"{root}/in")
    start_ingest(arrivals, v.items, f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    return ntz(v.spark.read.parquet(f"{root}/out/ticks").drop("epoch"), "inserted_at")


EXPIRE_S = 2 * 24 * 3600  # longer than the duplicate window, shorter than the live period


def carried(v: Views, ticks: DataFrame, chunk: Column, chunks: int, lookups, **options) -> str:
    """Runs the hot path with carried state over ``ticks``, which arrive chunk by chunk; returns the folder of its outputs.

    Each chunk is written and then taken as one micro-batch, so the order of arrival is fixed whatever the number of files.
    """
    root = scratch(v)
    for number in range(chunks):
        ticks.filter(chunk == number).write.parquet(f"{root}/in/chunk={number}")
        arrivals = v.spark.readStream.schema(ticks.schema).option("recursiveFileLookup", True).parquet(f"{root}/in")
        start_carried_path(arrivals, lookups, f"{root}/out", f"{root}/checkpoint", available_now=True, **options).awaitTermination()
    return f"{root}/out"


def live_carried(v: Views, **options) -> str:
    """The live ticks in three micro-batches by time, with every item beyond the limit for one task."""
    columns = ["id", "market_hash_name", "price_cents", "timestamp", "float_value", "stickers"]
    live = v.live_ticks
    start = F.unix_seconds(F.expr(SPLIT).cast("timestamp"))
    part = F.floor((F.col("timestamp") - start) / (6 * 24 * 3600))
    baselines = published(v)
    return carried(v, live.select(*columns), F.least(F.greatest(part, F.lit(0)), F.lit(2)), 3,
                   lambda: (v.items, baselines, v.sticker_prices), limit=30, **options)


@query("hot_path_carried", f"WITH RECURSIVE {DECIDE} SELECT {DECISION_COLUMNS} FROM decisions")
def hot_path_carried(v: Views) -> DataFrame:
    """Micro-batches through the batch kernels, with state in a table; the decisions equal those of the batch job."""
    return v.spark.read.parquet(f"{live_carried(v)}/decisions").select(*DECISION_COLUMNS.split(", "))


@query("live_state", f"""
    WITH RECURSIVE {DETECT},
    newest AS (SELECT market_hash_name, max((timestamp, id, price_cents)) AS n FROM (
      SELECT market_hash_name, timestamp, id, price_cents FROM accepted) GROUP BY market_hash_name)
    SELECT market_hash_name, n[3] AS last_price, n[1] AS last_second FROM newest
    WHERE n[1] >= (SELECT max(timestamp) FROM fx_live_ticks) - {EXPIRE_S}""")
def live_state(v: Views) -> DataFrame:
    """What the state holds in the end when silent items expire."""
    out = live_carried(v, expire_s=EXPIRE_S)
    last = epochs_before(v.spark, f"{out}/state", 1 << 40)[-1]
    state = v.spark.read.schema(no_state(v.spark).schema).parquet(f"{out}/state/epoch={last}")
    return state.select("market_hash_name", "last_price", "last_second")


@query("late_ticks", """
    WITH RECURSIVE numbered AS (
      SELECT *, row_number() OVER (PARTITION BY market_hash_name ORDER BY (id + 1) % 3, timestamp, id) AS rn FROM fx_dedup),
    walk AS (
      SELECT id, market_hash_name, rn, price_cents AS last_price, timestamp AS last_second, false AS is_duplicate
      FROM numbered WHERE rn = 1
      UNION ALL
      SELECT n.id, n.market_hash_name, n.rn, n.price_cents,
             CASE WHEN n.price_cents = w.last_price AND n.timestamp - w.last_second < 3600 THEN w.last_second ELSE n.timestamp END,
             n.price_cents = w.last_price AND n.timestamp - w.last_second < 3600
      FROM walk AS w JOIN numbered AS n ON n.market_hash_name = w.market_hash_name AND n.rn = w.rn + 1)
    SELECT id, is_duplicate FROM walk""")
def late_ticks(v: Views) -> DataFrame:
    """Three micro-batches that each hold ticks of the whole period, so two thirds of the ticks come late; a few hot items."""
    ticks = v.dedup.withColumn("float_value", F.lit(None).cast("double")).withColumn("stickers", F.expr("from_json('[]', 'array<struct<name:string>>')"))
    baselines = published(v)
    out = carried(v, ticks, (F.col("id") + 1) % 3, 3, lambda: (v.items, baselines, v.sticker_prices),
                  tuning=replace(DEFAULTS, dedup_window_s=3600), limit=1000)
    return v.spark.read.parquet(f"{out}/ticks").select("id", "is_duplicate")


DELAY_S = 600  # watermark of the monitoring streams


def appended(v: Views, tables: dict[str, DataFrame], build) -> DataFrame:
    """Rows that ``build`` of streams over ``tables`` appends; the tables arrive in two parts by event time.

    The parts are cut at one second for all tables, so no row comes late. Windows that the last watermark has not closed are not there.
    """
    root = scratch(v)
    cut = F.unix_seconds(F.expr(SPLIT).cast("timestamp")) + 10 * 24 * 3600
    timed_tables = {name: timed(stored(df)) for name, df in tables.items()}
    for part, rows in enumerate((F.col("timestamp") < cut, F.col("timestamp") >= cut)):
        for name, df in timed_tables.items():
            df.filter(rows).write.parquet(f"{root}/in/{name}/part={part}")
        streams = [
            v.spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{root}/in/{name}")
            .withWatermark("event_time", f"{DELAY_S} seconds") for name, df in timed_tables.items()
        ]
        found = build(*streams)
        (found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start(f"{root}/out").awaitTermination())
    return v.spark.read.schema(found.schema).parquet(f"{root}/out")


@query("activity_stream", f"""
    WITH RECURSIVE {DECIDE},
    seen AS (
      SELECT make_timestamp(n.timestamp * 1000000) AS event_time,
             CASE WHEN w.is_duplicate THEN 'deduplicated' ELSE 'processed' END AS kind
      FROM numbered AS n JOIN walk AS w ON w.id = n.id
      UNION ALL SELECT event_time, CASE WHEN approved THEN 'confirmed' ELSE 'rejected' END FROM decisions),
    closed AS (SELECT make_timestamp((least((SELECT max(timestamp) FROM fx_live_ticks),
                                            (SELECT max(timestamp) FROM decisions)) - {DELAY_S}) * 1000000) AS until)
    SELECT time_bucket(INTERVAL 1 MINUTE, event_time) AS window_start,
           count(*) FILTER (WHERE kind = 'processed') / CAST(60 AS DOUBLE) AS processed_per_s,
           count(*) FILTER (WHERE kind = 'deduplicated') / CAST(60 AS DOUBLE) AS deduplicated_per_s,
           count(*) FILTER (WHERE kind = 'confirmed') AS confirmed, count(*) FILTER (WHERE kind = 'rejected') AS rejected
    FROM seen, closed WHERE time_bucket(INTERVAL 1 MINUTE, event_time) + INTERVAL 1 MINUTE <= until GROUP BY 1""")
def activity_stream(v: Views) -> DataFrame:
    """Ticks and decisions as two streams, in append mode: all minutes that both watermarks have closed."""
    tables = {"ticks": flag_duplicates(v.live_ticks).select("timestamp", "is_duplicate"),
              "decisions": decisions(v).select("timestamp", "approved")}
    return ntz(appended(v, tables, M.activity_rates), "window_start")


@query("alerts_stream", f"""
    WITH RECURSIVE {DECIDE}, {SLIDING},
    minutes AS (SELECT time_bucket(INTERVAL 1 MINUTE, event_time) AS window_start, count(*) AS anomalies
                FROM decisions GROUP BY ALL),
    high AS (SELECT window_start, count(CASE WHEN anomalies > 50 THEN 1 END) OVER (ORDER BY window_start
               RANGE BETWEEN INTERVAL 1 MINUTE PRECEDING AND CURRENT ROW) AS hits FROM minutes),
    low AS (SELECT window_start, count(CASE WHEN confirmation_rate < 0.1 THEN 1 END) OVER (ORDER BY window_start
              RANGE BETWEEN INTERVAL 14 MINUTE PRECEDING AND CURRENT ROW) AS hits FROM rates),
    closed AS (SELECT make_timestamp((max(timestamp) - {DELAY_S}) * 1000000) AS until FROM decisions)
    SELECT window_start, 'high_anomaly_rate' AS alert FROM high, closed
    WHERE hits = 2 AND window_start + INTERVAL 1 MINUTE <= until
    UNION ALL SELECT window_start, 'low_confirmation_rate' FROM low, closed
    WHERE hits = 15 AND window_start + INTERVAL 15 MINUTE <= until""")
def alerts_stream(v: Views) -> DataFrame:
    """Alerts from a stream of decisions, in append mode: rates, and holds over them, each with the watermark."""
    return ntz(appended(v, {"decisions": decisions(v).select("timestamp", "approved")}, M.alerts_on_stream), "window_start")


@query("listing_stream", LISTED_SQL)
def listing_stream(v: Views) -> DataFrame:
    """Files of listing messages through the stream reader, two files per micro-batch; broken lines are skipped."""
    root = scratch(v)
    messages = listing_messages(v)
    broken = messages.filter("value LIKE '%sold%'").select(F.expr("substring(value, 1, length(value) - 2)").alias("value"))
    messages.unionByName(broken).write.text(f"{root}/in")
    read = listings.read_listing_stream(v.spark, f"{root}/in", F.lit(0), files_per_trigger=2)
    (read.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start(f"{root}/out").awaitTermination())
    return v.spark.read.schema(read.schema).parquet(f"{root}/out").select(
        *LISTED_COLUMNS, F.size("stickers").cast("bigint").alias("n_stickers"))
