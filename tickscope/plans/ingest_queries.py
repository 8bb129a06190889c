"""Queries over listings, ingest batches, quarantine and replay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.operators import ingest as I
from tickscope.operators import monitoring as M
from tickscope.plans.item_queries import ntz
from tickscope.plans.registry import Views, query
from tickscope.session import ensure_checkpoint_dir, stored
from tickscope.sources import listings as L

CHUNK = 500
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
SOURCES = ["click", "error", "purchase", "signup", "view"]

CHUNKS = f"""
      numbered AS (
        SELECT *, row_number() OVER (PARTITION BY marketplace_source ORDER BY timestamp, id) AS rn FROM fx_named_ticks),
      chunks AS (
        SELECT md5(concat_ws(':', marketplace_source, arg_min(timestamp, rn), arg_min(id, rn), arg_max(timestamp, rn),
                             arg_max(id, rn), count(*))) AS h, marketplace_source AS source,
               (rn - 1) // {CHUNK} AS chunk,
               list({{'market_hash_name': market_hash_name, 'price_cents': price_cents, 'timestamp': timestamp}}
                    ORDER BY rn) AS ticks
        FROM numbered GROUP BY marketplace_source, (rn - 1) // {CHUNK}),
      based AS (
        SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS batch_id,
               source, chunk, ticks, list_position({SOURCES!r}, source) + 10 * chunk AS slot FROM chunks)"""


def chunks(v: Views) -> DataFrame:
    return I.chunk_batches(v.named_ticks.withColumn("source", F.col("marketplace_source")), CHUNK)


@query("chunk_batches", f"""
    WITH {CHUNKS}
    SELECT batch_id, source, chunk, CAST(len(ticks) AS BIGINT) AS record_count,
           ticks[1].market_hash_name AS first_name, ticks[-1].timestamp AS last_timestamp,
           CAST(list_sum(list_transform(ticks, lambda t: t.price_cents)) AS BIGINT) AS total_cents
    FROM based""")
def chunk_batches(v: Views) -> DataFrame:
    total = F.aggregate("ticks", F.lit(0).cast("bigint"), lambda acc, t: acc + t["price_cents"])
    return chunks(v).select(
        "batch_id", "source", "chunk", F.size("ticks").cast("bigint").alias("record_count"),
        F.col("ticks")[0]["market_hash_name"].alias("first_name"),
        F.element_at("ticks", -1)["timestamp"].alias("last_timestamp"), total.alias("total_cents"),
    )


def _runs(part: str, condition: str) -> str:
    chosen = CHUNKS.replace("FROM fx_named_ticks)", f"FROM fx_named_ticks WHERE {condition})")
    return f"SELECT '{part}' AS run, * FROM (WITH {chosen} SELECT * FROM based)"


@query("chunk_batches_two_runs", f"""
    WITH runs AS (
      {_runs("first", "id % 2 = 0")} UNION ALL {_runs("second", "id % 2 = 1")} UNION ALL {_runs("again", "id % 2 = 0")})
    SELECT run, batch_id, CAST(len(ticks) AS BIGINT) AS record_count,
           CASE WHEN list_bool_or(list_transform(ticks, lambda t: t.price_cents <= 0)) THEN 'REJECTED'
                WHEN run = 'again' THEN 'DUPLICATE' ELSE 'SUCCESS' END AS status
    FROM runs""")
def chunk_batches_two_runs(v: Views) -> DataFrame:
    """Two runs over different ticks meet one ledger, and the first one runs again."""
    ticks = v.named_ticks.withColumn("source", F.col("marketplace_source"))
    first, second = (
        stored(I.chunk_batches(ticks.filter(F.col("id") % 2 == part), CHUNK).withColumn("pos", F.monotonically_increasing_id()))
        for part in (0, 1)
    )
    ledger = I.ingest_tick_batches(first, v.items, v.spark.createDataFrame([], schemas.INGESTION_BATCHES), F.expr(NOW)).ledger
    known = stored(ledger)
    runs = {"first": I.classify_batches(first, known.limit(0)), "second": I.classify_batches(second, known),
            "again": I.classify_batches(first, known)}
    out = None
    for run, found in runs.items():
        rows = found.select(F.lit(run).alias("run"), "batch_id", F.size("ticks").cast("bigint").alias("record_count"), "status")
        out = rows if out is None else out.unionByName(rows)
    return out


# Arrivals: every chunk, then a copy of chunk 0, a changed chunk 1, an empty batch, chunk 0 without an
# id, chunk 1 under its id in capitals, and a batch with a blank source. Chunk 2 is already in the
# ledger; so is chunk 3, with other content.
ARRIVALS = f"""
      {CHUNKS},
      arrivals AS (
        SELECT slot AS pos, batch_id, batch_id AS sent_id, source, ticks FROM based
        UNION ALL SELECT 1000000 + slot, batch_id, batch_id, source, ticks FROM based WHERE chunk = 0
        UNION ALL SELECT 2000000 + slot, batch_id, batch_id, source, list_transform(ticks, lambda t: {{
            'market_hash_name': t.market_hash_name, 'price_cents': t.price_cents + 1, 'timestamp': t.timestamp}})
          FROM based WHERE chunk = 1
        UNION ALL SELECT 3000000 + slot, left(batch_id, 34) || 'ff', left(batch_id, 34) || 'ff', source, [] FROM based
          WHERE chunk = 0
        UNION ALL SELECT 4000000 + slot, NULL, NULL, source, ticks FROM based WHERE chunk = 0
        UNION ALL SELECT 5000000 + slot, batch_id, upper(batch_id), source, ticks FROM based WHERE chunk = 1
        UNION ALL SELECT 6000000 + slot, batch_id, batch_id, '  ', ticks FROM based WHERE chunk = 0),
      checked AS (
        SELECT *, trim(source) = '' OR coalesce(list_bool_or(list_transform(ticks, lambda t: t.price_cents <= 0)), false)
               AS invalid FROM arrivals),
      firsts AS (
        SELECT batch_id, min(pos) AS pos, arg_min(ticks, pos) AS ticks FROM checked
        WHERE NOT invalid AND batch_id IS NOT NULL GROUP BY batch_id),
      classified AS (
        SELECT c.pos, c.batch_id, c.source, c.ticks, CASE
                 WHEN invalid THEN 'REJECTED'
                 WHEN l.chunk = 2 THEN CASE WHEN c.ticks = l.ticks THEN 'DUPLICATE' ELSE 'CONFLICT' END
                 WHEN l.chunk = 3 THEN 'CONFLICT'
                 WHEN c.batch_id IS NULL OR f.pos = c.pos THEN CASE WHEN len(c.ticks) = 0 THEN 'SKIPPED' ELSE 'SUCCESS' END
                 WHEN f.ticks = c.ticks THEN 'DUPLICATE' ELSE 'CONFLICT' END AS status
        FROM checked AS c LEFT JOIN firsts AS f ON f.batch_id = c.batch_id
        LEFT JOIN based AS l ON l.batch_id = c.batch_id AND l.chunk IN (2, 3))"""


def arrivals(v: Views) -> tuple[DataFrame, DataFrame]:
    """Incoming batches and the ledger before them."""
    base = stored(chunks(v)).withColumn(
        "slot", F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")) + 10 * F.col("chunk")
    )
    raised = F.transform("ticks", lambda t: t.withField("price_cents", t["price_cents"] + 1))
    empty = F.array().cast(schemas.BATCH_TICKS)

    def variant(number: int, chunk: int | None, **changes) -> DataFrame:
        rows = base if chunk is None else base.filter(F.col("chunk") == chunk)
        fields = {"batch_id": F.col("batch_id"), "source": F.col("source"), "ticks": F.col("ticks"), **changes}
        return rows.select((F.col("slot") + number * 1_000_000).alias("pos"), *[c.alias(n) for n, c in fields.items()])

    batches = variant(0, None)
    for other in (
        variant(1, 0),
        variant(2, 1, ticks=raised),
        variant(3, 0, batch_id=F.concat(F.substring("batch_id", 1, 34), F.lit("ff")), ticks=empty),
        variant(4, 0, batch_id=F.lit(None).cast("string")),
        variant(5, 1, batch_id=F.upper("batch_id")),
        variant(6, 0, source=F.lit("  ")),
    ):
        batches = batches.unionByName(other)
    digest = F.when(F.col("chunk") == 2, I.payload_digest()).otherwise(F.lit("other content"))
    ledger = base.filter(F.col("chunk").isin(2, 3)).select(
        "batch_id", "source", F.size("ticks").cast("bigint").alias("record_count"), digest.alias("payload_sha256"),
        F.expr(NOW).alias("received_at"),
    )
    return batches, ledger


def ingested(v: Views) -> I.Ingest:
    batches, ledger = arrivals(v)
    return I.ingest_tick_batches(batches, v.items.filter("item_type <> 'Glove'"), ledger, F.expr(NOW))


@query("classify_batches", f"WITH {ARRIVALS} SELECT pos, batch_id, status FROM classified")
def classify_batches(v: Views) -> DataFrame:
    return I.classify_batches(*arrivals(v)).select("pos", "batch_id", "status")


@query("ingest_statuses", f"""
    WITH {ARRIVALS}
    SELECT pos, status, CAST(CASE WHEN status = 'SUCCESS' THEN len(ticks) ELSE 0 END AS BIGINT) AS records_processed
    FROM classified""")
def ingest_statuses(v: Views) -> DataFrame:
    return ingested(v).statuses.select("pos", "status", "records_processed")


@query("ingest_tick_batches", f"""
    WITH {ARRIVALS},
    stored AS (SELECT batch_id, source, unnest(ticks) AS t FROM classified WHERE status = 'SUCCESS'),
    known AS (SELECT * FROM fx_items WHERE item_type <> 'Glove'),
    fresh AS (
      SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY name) AS id, name AS market_hash_name
      FROM (SELECT DISTINCT t.market_hash_name AS name FROM stored)
      WHERE name NOT IN (SELECT market_hash_name FROM known)),
    everyone AS (SELECT id, market_hash_name FROM known UNION ALL SELECT * FROM fresh)
    SELECT batch_id, i.id AS item_id, t.price_cents AS price_cents, source AS marketplace_source,
           make_timestamp(t.timestamp * 1000000) AS inserted_at
    FROM stored JOIN everyone AS i ON i.market_hash_name = t.market_hash_name""")
def ingest_tick_batches(v: Views) -> DataFrame:
    return ntz(ingested(v).ticks, "inserted_at")


@query("ingest_ledger", f"""
    WITH {ARRIVALS}
    SELECT batch_id, source, CAST(len(ticks) AS BIGINT) AS record_count, {NOW} AS received_at
    FROM classified WHERE status IN ('SUCCESS', 'SKIPPED') AND batch_id IS NOT NULL""")
def ingest_ledger(v: Views) -> DataFrame:
    # digests are only ever compared with our own
    return ntz(ingested(v).ledger.drop("payload_sha256"), "received_at")


@query("batch_outcomes", f"""
    WITH {ARRIVALS}
    SELECT time_bucket(INTERVAL 1 MINUTE, make_timestamp(1704067200000000 + (pos % 1000000) * 1000000)) AS window_start,
           count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'SKIPPED') AS skipped,
           count(*) FILTER (WHERE status = 'DUPLICATE') AS duplicate,
           count(*) FILTER (WHERE status = 'CONFLICT') AS conflict, count(*) FILTER (WHERE status = 'REJECTED') AS rejected,
           CAST(count(*) FILTER (WHERE status IN ('CONFLICT', 'REJECTED')) AS DOUBLE) / CAST(count(*) AS DOUBLE)
             AS failed_share
    FROM classified GROUP BY ALL""")
def batch_outcomes(v: Views) -> DataFrame:
    statuses = I.classify_batches(*arrivals(v))
    timed = statuses.withColumn("event_time", F.timestamp_seconds(F.lit(1704067200) + F.col("pos") % 1_000_000))
    return ntz(M.batch_outcomes(timed), "window_start")


def stored_records(v: Views) -> DataFrame:
    """Stream records: good batches, spoilt envelopes, and chat turns in place of a payload."""
    base = stored(chunks(v))
    good = F.to_json(F.struct("batch_id", "source", "ticks"))

    def records(kind: str, payload) -> DataFrame:
        return base.select(F.lit("pending").alias("source_stream"),
                           F.concat_ws("-", F.lit(kind), "source", "chunk").alias("record_id"), payload.alias("payload"))

    out = records("good", good)
    spoilt = {
        "no-id": F.to_json(F.struct("source", "ticks")),
        "number-id": F.to_json(F.struct(F.col("chunk").alias("batch_id"), "source", "ticks")),
        "bad-uuid": F.to_json(F.struct(F.col("source").alias("batch_id"), "source", "ticks")),
        "blank-source": F.to_json(F.struct("batch_id", F.lit("  ").alias("source"), "ticks")),
        "no-list": F.to_json(F.struct("batch_id", "source", F.lit("none").alias("ticks"))),
        "no-objects": F.to_json(F.struct("batch_id", "source", F.array(F.col("chunk")).alias("ticks"))),
        "list": F.to_json(F.array("batch_id")),
        "empty": F.lit(None).cast("string"),
    }
    for kind, payload in spoilt.items():
        out = out.unionByName(records(kind, payload))
    chat = v.table("conversations").select(
        F.lit("pending").alias("source_stream"), F.concat_ws("-", F.lit("chat"), "conv_id", "turn").alias("record_id"),
        F.col("text").alias("payload"),
    )
    return out.unionByName(chat)


SPOILT = """(VALUES ('no-id', 'batch_id must be a non-empty string'), ('number-id', 'batch_id must be a non-empty string'),
             ('bad-uuid', 'batch_id is not a UUID'), ('blank-source', 'source must be a non-empty string'),
             ('no-list', 'ticks must be a list of objects'), ('no-objects', 'ticks must be a list of objects'),
             ('list', 'payload must be a JSON object'), ('empty', 'record has no payload')) AS s(kind, last_error)"""


@query("quarantined_batches", f"""
    WITH {CHUNKS}
    SELECT kind || '-' || source || '-' || chunk AS record_id, last_error FROM based, {SPOILT}
    UNION ALL
    SELECT 'chat-' || conv_id || '-' || turn, 'payload is not valid JSON' FROM conversations""")
def quarantined_batches(v: Views) -> DataFrame:
    return I.split_malformed(stored_records(v)).quarantine.select("record_id", "last_error")


@query("split_malformed", f"""
    WITH {CHUNKS}
    SELECT 'good-' || source || '-' || chunk AS record_id, batch_id, source, CAST(len(ticks) AS BIGINT) AS n_ticks
    FROM based""")
def split_malformed(v: Views) -> DataFrame:
    valid = I.split_malformed(stored_records(v)).valid
    return valid.select("record_id", "batch_id", "source", F.size("ticks").cast("bigint").alias("n_ticks"))


def replayed(v: Views) -> I.Replay:
    batches, ledger = arrivals(v)
    dead = batches.filter(F.col("batch_id").isNotNull()).select(
        F.lit("dead-letter").alias("source_stream"), F.concat(F.col("pos").cast("string"), F.lit("-0")).alias("record_id"),
        F.to_json(F.struct("batch_id", "source", "ticks")).alias("payload"),
    )
    return I.replay_dead_letters(dead, v.items, ledger, 15, F.expr(NOW))


# blank sources never pass the envelope check; the 15 oldest records are tried
REPLAY = f"""
      {ARRIVALS},
      tried AS (SELECT * FROM checked WHERE batch_id IS NOT NULL AND trim(source) <> '' ORDER BY pos LIMIT 15),
      firsts_tried AS (
        SELECT batch_id, min(pos) AS pos, arg_min(ticks, pos) AS ticks FROM tried WHERE NOT invalid GROUP BY batch_id),
      outcomes AS (
        SELECT t.pos, NOT invalid AND (CASE WHEN l.chunk = 2 THEN t.ticks = l.ticks WHEN l.chunk = 3 THEN false
                                            ELSE f.ticks = t.ticks END) AS stored
        FROM tried AS t LEFT JOIN firsts_tried AS f ON f.batch_id = t.batch_id
        LEFT JOIN based AS l ON l.batch_id = t.batch_id AND l.chunk IN (2, 3))"""


@query("replay_summary", f"""
    WITH {REPLAY}
    SELECT count(*) AS attempted, count(*) FILTER (WHERE stored) AS succeeded,
           count(*) FILTER (WHERE NOT stored) AS failed FROM outcomes""")
def replay_summary(v: Views) -> DataFrame:
    return replayed(v).summary


@query("replay_dead_letters", f"""
    WITH {REPLAY}
    SELECT pos || '-0' AS record_id FROM checked WHERE batch_id IS NOT NULL AND trim(source) <> ''
      AND pos NOT IN (SELECT pos FROM outcomes WHERE stored)""")
def replay_dead_letters(v: Views) -> DataFrame:
    return replayed(v).remaining.select("record_id")


LISTED_SQL = """
    SELECT p.market_hash_name, CAST(t.price_cents AS DOUBLE) / 100 AS price_usd, t.price_cents, float_value,
           CAST(len(stickers) AS BIGINT) AS n_stickers
    FROM fx_ticks AS t JOIN fx_parts AS p ON p.part_id = t.item_id
    WHERE marketplace_source <> 'purchase' AND k <> 0"""


def listing_messages(v: Views) -> DataFrame:
    """``value``: the ticks as listing messages; some are of sales, some without a name."""
    sale = F.struct(
        F.when(F.col("k") == 0, F.lit("")).otherwise(F.col("base_name")).alias("marketHashName"),
        F.col("price_cents").alias("salePrice"), F.col("float_value").alias("wear"), "stickers",
        F.col("phase").alias("version"),
    )
    event = F.when(F.col("marketplace_source") == "purchase", F.lit("sold")).otherwise(F.lit("listed"))
    parts = v.parts.select(F.col("part_id").alias("item_id"), "base_name", "phase")
    message = F.to_json(F.struct(event.alias("eventType"), F.array(sale).alias("sales")))
    return v.ticks.join(parts, "item_id").select(message.alias("value"))


LISTED_COLUMNS = ["market_hash_name", "price_usd", "price_cents", "float_value"]


@query("listing_ticks", LISTED_SQL)
def listing_ticks(v: Views) -> DataFrame:
    """Ticks written as listing messages and read back; sales events and unnamed ones drop out."""
    return L.listing_ticks(listing_messages(v), F.lit(0)).select(
        *LISTED_COLUMNS, F.size("stickers").cast("bigint").alias("n_stickers"))


SNAPSHOT_SQL = """
    SELECT market_hash_name, p_retailprice AS price_usd, CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS price_cents
    FROM fx_parts WHERE p_size > 1"""


def snapshot_entries(v: Views) -> DataFrame:
    return v.parts.select(
        "part_id",
        F.col("base_name").alias("market_hash_name"), F.col("phase").alias("version"),
        F.when(F.col("p_size") > 1, F.col("p_retailprice")).alias("min_price"),
    )


@query("snapshot_ticks", SNAPSHOT_SQL)
def snapshot_ticks(v: Views) -> DataFrame:
    return L.snapshot_ticks(snapshot_entries(v), F.lit(0)).select("market_hash_name", "price_usd", "price_cents")


@query("read_snapshots", SNAPSHOT_SQL)
def read_snapshots(v: Views) -> DataFrame:
    """Snapshot files, each a JSON list of at most 500 entries, through the reader."""
    ensure_checkpoint_dir(v.spark)
    folder = f"{v.spark.sparkContext.getCheckpointDir()}/snapshots/{uuid.uuid4().hex}"
    entry = F.struct("market_hash_name", "version", "min_price")
    lists = snapshot_entries(v).groupBy(F.floor(F.col("part_id") / 500).alias("file")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    lists.write.partitionBy("file").text(folder)
    return L.read_listing_snapshot(v.spark, folder, F.lit(0)).select("market_hash_name", "price_usd", "price_cents")
