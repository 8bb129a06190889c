"""Tick validation, batching and idempotent batch ingest with quarantine and replay."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.functions.names import item_type
from tickscope.functions.pricing import to_cents
from tickscope.operators.joins import lookup
from tickscope.operators.ordering import GROUP_ROWS, number_rows
from tickscope.session import stored

# Fixed values.
BATCH_TICKS = 2500
ERROR_CHARS = 500
UUID_HEX = "^[0-9a-f]{32}$"
STORED = ["SUCCESS", "SKIPPED", "DUPLICATE"]


class TickSplit(NamedTuple):
    good: DataFrame
    bad: DataFrame


class EnvelopeSplit(NamedTuple):
    valid: DataFrame
    quarantine: DataFrame


class Ingest(NamedTuple):
    ticks: DataFrame
    items: DataFrame
    ledger: DataFrame
    statuses: DataFrame
    changed_items: DataFrame  # the rows of ``items`` that are new or have another type than before


class Replay(NamedTuple):
    summary: DataFrame
    remaining: DataFrame
    quarantine: DataFrame
    ingest: Ingest


def non_blank(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) > 0, F.lit(False))


def validate_ticks(raw: DataFrame, now: Column) -> TickSplit:
    """Split on a present name and a positive price; a missing timestamp becomes ``now``."""
    price = F.col("price_usd")
    error = (
        F.when(F.col("market_hash_name").isNull(), F.lit("name is missing"))
        .when(price.isNull() | F.isnan(price), F.lit("price is missing"))
        .when(price <= 0, F.lit("price must be positive"))
        .when(to_cents(price).isNull(), F.lit("price is out of range"))
    )
    tagged = raw.withColumn("error", error)
    good = (
        tagged.filter(F.col("error").isNull())
        .drop("error")
        .withColumn("price_cents", to_cents(price))
        .withColumn("timestamp", F.coalesce("timestamp", now.cast("bigint")))
    )
    return TickSplit(good, tagged.filter(F.col("error").isNotNull()))


def uuid_of(*parts: Column) -> Column:
    """A UUID-shaped text that depends only on ``parts``, so reruns give the same id."""
    digest = F.md5(F.concat_ws(":", *parts))
    pieces = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *pieces)


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated UUID from the usual spellings; null when it is none."""
    plain = F.lower(F.regexp_replace(text, r"^(?i:urn:)?(?i:uuid:)?|[{}\-]", ""))
    spelled = F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(plain.rlike(UUID_HEX), spelled)


def chunk_batches(ticks: DataFrame, n: int = BATCH_TICKS, limit: int = GROUP_ROWS) -> DataFrame:
    """Batches of ``n`` ticks per source in (timestamp, id) order, with stable batch ids.

    The id names the source, the first and the last tick and their number: a rerun over the same ticks gives
    the same ids, and the chunks of a later run, which start from 0 again, get others. A group is one
    batch, so it has at most ``n`` ticks however large the source is.
    """
    numbered = number_rows(ticks, ["source"], ["timestamp", "id"], "_rn", limit)
    tick = F.struct("_rn", "market_hash_name", "price_cents", "timestamp")
    grouped = (
        numbered.withColumn("chunk", F.expr(f"(_rn - 1) div {n}"))
        .groupBy("source", "chunk")
        .agg(
            F.sort_array(F.collect_list(tick)).alias("_t"),
            F.min(F.struct("_rn", "timestamp", "id")).alias("_first"), F.max(F.struct("_rn", "timestamp", "id")).alias("_last"),
        )
    )
    content = [F.col(c).cast("string") for c in ("_first.timestamp", "_first.id", "_last.timestamp", "_last.id")]
    bare = F.transform("_t", lambda t: F.struct(t["market_hash_name"], t["price_cents"], t["timestamp"]))
    return grouped.select(
        uuid_of(F.col("source"), *content, F.size("_t").cast("string")).alias("batch_id"), "source", "chunk",
        bare.cast(schemas.BATCH_TICKS).alias("ticks"),
    )


def payload_digest() -> Column:
    """Digest of source and ticks of a batch."""
    return F.sha2(F.to_json(F.struct("source", "ticks")), 256)


def classify_batches(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Status per batch (``pos`` is the arrival order).

    REJECTED: invalid content. SKIPPED: no ticks. DUPLICATE: the id is known with the same
    content. CONFLICT: known with other content. SUCCESS: new. The first batch of an id in this
    run counts as known for the later ones. A null id bypasses the ledger.
    """
    bad_tick = F.exists(
        "ticks",
        lambda t: t["market_hash_name"].isNull() | t["timestamp"].isNull() | ~F.coalesce(t["price_cents"] > 0, F.lit(False)),
    )
    invalid = (
        ~non_blank(F.col("source")) | F.col("ticks").isNull() | F.coalesce(bad_tick, F.lit(True))
        | (F.col("batch_id").isNotNull() & canonical_uuid(F.col("batch_id")).isNull())
    )
    checked = (
        batches.withColumn("_invalid", invalid)
        .withColumn("batch_id", F.coalesce(canonical_uuid(F.col("batch_id")), "batch_id"))
        .withColumn("digest", payload_digest())
    )
    # one row per batch id, combined map-side: a batch sent again and again stays cheap
    first = checked.filter(~F.col("_invalid") & F.col("batch_id").isNotNull()).groupBy("batch_id").agg(
        F.min(F.struct("pos", "digest")).alias("_first")
    )
    owners = first.join(ledger.select("batch_id", F.col("payload_sha256").alias("_stored")), "batch_id", "left")
    known = lookup(checked, owners, "batch_id", derived=True)
    empty = F.size("ticks") == 0
    owns = F.col("batch_id").isNull() | (F.col("_stored").isNull() & (F.col("_first.pos") == F.col("pos")))
    status = (
        F.when(F.col("_invalid"), F.lit("REJECTED"))
        .when(owns & empty, F.lit("SKIPPED"))
        .when(owns, F.lit("SUCCESS"))
        .when(F.coalesce("_stored", "_first.digest") == F.col("digest"), F.lit("DUPLICATE"))
        .otherwise(F.lit("CONFLICT"))
    )
    return known.withColumn("status", status).drop("_invalid", "_first", "_stored")


def changed_items(names: DataFrame, items: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """The rows that registering ``names`` adds or changes: known items whose classification differs
    keep their id, new names get the next ids in name order. Stored, since callers use it more than once."""
    wanted = stored(names.select("market_hash_name").filter(F.col("market_hash_name").isNotNull()).distinct())
    current = item_type(F.col("market_hash_name"))
    known = lookup(items, wanted, "market_hash_name", "inner").filter(~current.eqNullSafe(F.col("item_type"))).select(
        "id", "market_hash_name", current.alias("item_type"), "rarity")
    top = items.agg(F.max("id")).first()[0]
    fresh = stored(wanted.join(items.select("market_hash_name"), "market_hash_name", "left_anti"))
    numbered = number_rows(fresh, [], ["market_hash_name"], "_rn", limit).select(
        (F.col("_rn") + F.lit(0 if top is None else top)).alias("id"), "market_hash_name",
        current.alias("item_type"), F.lit(None).cast("string").alias("rarity"),
    )
    return stored(known.unionByName(numbered))


def with_changes(items: DataFrame, changed: DataFrame) -> DataFrame:
    """``items`` with the rows of ``changed`` in place of those with the same id and name."""
    columns = ["id", "market_hash_name", "item_type", "rarity"]
    kept = items.select(*columns).join(changed.select("id", "market_hash_name"), ["id", "market_hash_name"], "left_anti")
    return kept.select(*columns).unionByName(changed.select(*columns))


def upsert_items(names: DataFrame, items: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """All items after registering ``names``: known ones keep their id and get the current
    classification, new ones get the next ids in name order."""
    return with_changes(items, changed_items(names, items, limit))


def ingest_tick_batches(batches: DataFrame, items: DataFrame, ledger: DataFrame, received_at: Column) -> Ingest:
    """Ticks to store, items afterwards, new ledger rows and the status of every batch."""
    classified = stored(classify_batches(batches, ledger))
    new = classified.filter(F.col("status") == "SUCCESS")
    ticks = new.select(
        "batch_id", F.col("source").alias("marketplace_source"), F.explode("ticks").alias("_t")
    ).select(
        "batch_id", "_t.market_hash_name", "_t.price_cents", "marketplace_source",
        F.timestamp_seconds("_t.timestamp").alias("inserted_at"),
    )
    changed = changed_items(ticks, items)
    items_after = with_changes(items, changed)
    ids = items_after.select("market_hash_name", F.col("id").alias("item_id"))
    rows = lookup(ticks, ids, "market_hash_name").select(
        "batch_id", "item_id", "price_cents", "marketplace_source", "inserted_at"
    )
    registered = classified.filter(F.col("status").isin("SUCCESS", "SKIPPED") & F.col("batch_id").isNotNull()).select(
        "batch_id", "source", F.size("ticks").cast("bigint").alias("record_count"),
        F.col("digest").alias("payload_sha256"), received_at.alias("received_at"),
    )
    processed = F.when(F.col("status") == "SUCCESS", F.size("ticks")).otherwise(F.lit(0)).cast("bigint")
    statuses = classified.select("pos", "batch_id", "source", "status", processed.alias("records_processed"))
    return Ingest(rows, items_after, registered, statuses, changed)


def split_malformed(raw: DataFrame) -> EnvelopeSplit:
    """Stored batch records (source_stream, record_id, payload) that are well-formed, and the rest.

    The envelope must be a JSON object with a UUID ``batch_id``, a non-blank ``source`` and
    ``ticks`` as a list of objects. Types are checked on the parsed value, so a number is not
    taken for a text.
    """
    value = F.try_parse_json("payload")
    field = {name: F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))
             for name in ("batch_id", "source", "ticks")}
    batch_id = F.try_variant_get("_v", "$.batch_id", "string")
    source = F.try_variant_get("_v", "$.source", "string")

    def lacks(name: str, kinds: str) -> Column:
        return ~F.coalesce(field[name].rlike(kinds), F.lit(False))

    error = (
        F.when(F.col("payload").isNull(), F.lit("record has no payload"))
        .when(F.col("_v").isNull(), F.lit("payload is not valid JSON"))
        .when(~F.schema_of_variant("_v").startswith("OBJECT"), F.lit("payload must be a JSON object"))
        .when(lacks("batch_id", "^STRING$") | (batch_id == ""), F.lit("batch_id must be a non-empty string"))
        .when(canonical_uuid(batch_id).isNull(), F.lit("batch_id is not a UUID"))
        .when(lacks("source", "^STRING$") | ~non_blank(source), F.lit("source must be a non-empty string"))
        .when(lacks("ticks", "^ARRAY<(OBJECT|VOID)"), F.lit("ticks must be a list of objects"))
    )
    tagged = raw.withColumn("_v", value).withColumn("last_error", F.substring(error, 1, ERROR_CHARS))
    body = F.from_json("payload", f"batch_id STRING, source STRING, ticks {schemas.BATCH_TICKS}")
    valid = tagged.filter(F.col("last_error").isNull()).withColumn("_b", body).select(
        "source_stream", "record_id", "payload", "_b.batch_id", "_b.source", "_b.ticks"
    )
    quarantine = tagged.filter(F.col("last_error").isNotNull()).select(
        "source_stream", "record_id", F.coalesce("payload", F.lit("")).alias("payload"), "last_error"
    )
    return EnvelopeSplit(valid, quarantine)


def record_order(record_id: Column) -> list[Column]:
    """Stream record ids ``<ms>-<seq>`` in numeric order."""
    parts = F.split(record_id, "-")
    return [F.get(parts, 0).try_cast("bigint"), F.get(parts, 1).try_cast("bigint"), record_id]


def in_record_order(records: DataFrame) -> DataFrame:
    """Records with their age as ``pos``, a struct that compares as record ids do.

    Ingest needs minima and equality of ``pos`` only, so records are neither numbered nor gathered.
    """
    milliseconds, sequence, record_id = record_order(F.col("record_id"))
    return records.withColumn("pos", F.struct(milliseconds.alias("ms"), sequence.alias("seq"), record_id.alias("record_id")))


def replay_dead_letters(
    dead: DataFrame, items: DataFrame, ledger: DataFrame, limit: int, received_at: Column
) -> Replay:
    """Send the oldest ``limit`` dead letters through ingest again.

    Accepted, empty and duplicate batches leave the table; the others stay for a later attempt.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    valid, quarantine = split_malformed(dead)
    attempts = stored(valid.orderBy(*record_order(F.col("record_id"))).limit(limit))
    ordered = in_record_order(attempts)
    ingest = ingest_tick_batches(ordered, items, ledger, received_at)
    done = ordered.select("record_id", "pos").join(ingest.statuses.filter(F.col("status").isin(STORED)), "pos")
    succeeded = F.col("status").isin(STORED)
    summary = ingest.statuses.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(succeeded).alias("succeeded"),
        F.count_if(~succeeded).alias("failed"),
    )
    remaining = valid.join(done.select("record_id"), "record_id", "left_anti").select(
        "source_stream", "record_id", "payload"
    )
    return Replay(summary, remaining, quarantine, ingest)
