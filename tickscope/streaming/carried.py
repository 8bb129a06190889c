"""The hot path with its state in a table: micro-batches go through the batch kernels, so a hot item uses many tasks.

State is one row per item: the last accepted tick in order of arrival and the newest accepted ticks. A micro-batch is joined with it,
range-partitioned like a batch job, and writes the next state. Items that have been silent for longer than
``expire_s``, measured in event time, leave the state.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickscope import schemas
from tickscope.functions.scoring import DEFAULTS, Tuning
from tickscope.operators.anomaly import append_trades, judge, with_baseline, with_score
from tickscope.operators.dedup import DUPLICATE, flag_duplicates, price_windows
from tickscope.operators.joins import lookup
from tickscope.operators.ordering import GROUP_ROWS, latest_rows
from tickscope.session import scratch_tables, stored
from tickscope.sources.tables import epochs_before, remove_epochs

KEY = "market_hash_name"
STATE = (
    f"{KEY} STRING, last_price BIGINT, last_second BIGINT, "
    "members ARRAY<STRUCT<timestamp: BIGINT, id: BIGINT, price_cents: BIGINT>>, seen BIGINT"
)


class Step(NamedTuple):
    ticks: DataFrame  # the micro-batch with ``is_duplicate`` and, for accepted ticks, the moments of the window before
    state: DataFrame


def no_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def judge_duplicates(ticks: DataFrame, state: DataFrame, tuning: Tuning = DEFAULTS, limit: int = GROUP_ROWS) -> DataFrame:
    """``ticks`` of one micro-batch with ``is_duplicate``, continuing from ``state``; order is (timestamp, id).

    Only the ticks before an item's first break (another price than the last accepted one, or its window over) depend
    on the state, and all of them are duplicates. The first break is a minimum, combined in each task; behind it the
    batch kernel starts afresh. A late tick is judged as it arrives: its age against the last accepted tick is negative.
    """
    last = state.select(KEY, "last_price", "last_second")
    known = stored(lookup(ticks, last, KEY))
    breaks = F.col("last_price").isNull() | (F.col("price_cents") != F.col("last_price")) | (
        F.col("timestamp") - F.col("last_second") >= tuning.dedup_window_s)
    first = known.filter(breaks).groupBy(KEY).agg(F.min(F.struct("timestamp", "id")).alias("first"))
    placed = stored(lookup(known, first, KEY, derived=True).withColumn(
        "held", F.coalesce(F.struct("timestamp", "id") < F.col("first"), F.lit(True))).select(*ticks.columns, "held"))
    free = placed.filter(~F.col("held")).drop("held")
    return placed.filter("held").drop("held").withColumn(DUPLICATE, F.lit(True)).unionByName(
        flag_duplicates(free, window_s=tuning.dedup_window_s, limit=limit))


def advance(ticks: DataFrame, state: DataFrame, tuning: Tuning = DEFAULTS, limit: int = GROUP_ROWS,
            expire_s: int | None = None) -> Step:
    """One micro-batch: judged ticks and the state after it.

    A window holds the accepted ticks before a tick in (timestamp, id) order, of this micro-batch and of the ``window_size - 1`` that the
    state keeps. State rows are bounded by the items seen within ``expire_s`` before the newest tick (``None``: for ever).
    """
    if expire_s is not None and expire_s < tuning.dedup_window_s:
        raise ValueError("state must outlive the duplicate window")
    size = tuning.window_size
    flagged = stored(judge_duplicates(ticks, state, tuning, limit))
    accepted = flagged.filter(~F.col(DUPLICATE))
    touched = stored(accepted.groupBy(KEY).agg(F.max(F.struct("timestamp", "id", "price_cents")).alias("newest")))
    mine = state.join(touched.select(KEY), KEY, "left_semi")
    old = mine.select(KEY, F.explode("members").alias("m")).select(KEY, "m.*", F.lit(True).alias("old"))
    new = accepted.select(KEY, "timestamp", "id", "price_cents", F.lit(False).alias("old"))
    both = stored(old.unionByName(new))
    moments = price_windows(both, size=size, limit=limit).filter(~F.col("old")).select("id", "n", "sx", "sxx")
    judged = flagged.join(moments, "id", "left")

    kept = latest_rows(both, KEY, [F.desc("timestamp"), F.desc("id")], size - 1, "place").groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct("timestamp", "id", "price_cents"))).alias("members"))
    updated = touched.join(kept, KEY).select(
        KEY, F.col("newest.price_cents").alias("last_price"), F.col("newest.timestamp").alias("last_second"), "members")
    untouched = state.join(touched.select(KEY), KEY, "left_anti").drop("seen")
    seen = max((r.seen for r in (state.agg(F.max("seen").alias("seen")).first(), ticks.agg(F.max("timestamp").alias("seen")).first())
                if r.seen is not None), default=None)
    after = updated.unionByName(untouched).withColumn("seen", F.lit(seen).cast("bigint"))
    if expire_s is not None:
        # The newest kept tick counts too: a late tick can be an item's last one.
        newest = F.greatest(F.col("last_second"), F.element_at("members", -1)["timestamp"])
        after = after.filter(newest >= F.col("seen") - expire_s)
    return Step(judged, after)


def start_carried_path(
    ticks: DataFrame,
    lookups: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    out: str,
    checkpoint: str,
    tuning: Tuning = DEFAULTS,
    limit: int = GROUP_ROWS,
    expire_s: int | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """The hot path (ticks, decisions, trades, items and state below ``out``, one folder per micro-batch).

    ``lookups`` returns (items, published baselines, sticker prices), as for the per-item form. A micro-batch that runs again reads the
    state before it and overwrites its outputs; the state is written last, and only its two newest versions stay.
    """
    def process(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        items, baselines, stickers = lookups()

        def write(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")

        def before(name: str, schema) -> DataFrame | None:
            known = epochs_before(spark, f"{out}/{name}", epoch)[-1:]
            return spark.read.schema(schema).parquet(f"{out}/{name}/epoch={known[0]}") if known else None

        state, named = before("state", STATE), before("items", schemas.MARKET_ITEMS)
        if named is not None:
            items = named.unionByName(items.join(named, KEY, "left_anti").select(*named.columns))
        with scratch_tables(spark):
            step = advance(stored(rows), no_state(spark) if state is None else state, tuning, limit, expire_s)
            write(step.ticks, "ticks")
            judged = spark.read.schema(step.ticks.schema).parquet(f"{out}/ticks/epoch={epoch}").filter(~F.col(DUPLICATE))
            scored = with_score(with_baseline(judged, baselines), tuning)
            write(judge(scored, stickers, tuning), "decisions")
            log = append_trades(spark.read.parquet(f"{out}/decisions/epoch={epoch}"), items)
            write(log.trades, "trades")
            write(log.items, "items")
            write(step.state, "state")
        remove_epochs(spark, f"{out}/state", epoch - 1)

    writer = ticks.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
