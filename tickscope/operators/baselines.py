"""Long-term price baselines per item and their published lookup tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickscope.functions.pricing import half_even
from tickscope.functions.scoring import sample_variance
from tickscope.operators.joins import lookup
from tickscope.operators.ordering import GROUP_ROWS, latest_rows, with_frames
from tickscope.operators.quantiles import exact_quantile
from tickscope.session import stored
from tickscope.sources.runs import append_run, compact_runs, read_runs

# Windows are row counts, not days.
SHORT_ROWS, LONG_ROWS = 30, 90
FLOOR_QUANTILE = 0.10

BASELINE_FIELDS = [
    "item_id", "latest_price_cents", "rolling_30d_avg_cents", "rolling_90d_avg_cents", "drift_percent",
    "volatility_cents", "avg_volume_30d", "support_floor_cents",
]


def rolling_averages(history: DataFrame, ties: list[str] | None = None, limit: int = GROUP_ROWS) -> DataFrame:
    """Mean price over the last 30 and 90 rows of the item, at every row.

    Both come from differences of one running sum, so a row costs the same for any width.
    """
    order = ["sale_date", *(ties or [])]

    def mean_of(rows: int):
        def build(window) -> Column:
            running = F.sum("median_price_cents").over(window.rowsBetween(W.unboundedPreceding, 0))
            known = F.count("median_price_cents").over(window.rowsBetween(W.unboundedPreceding, 0))
            dropped = F.sum("median_price_cents").over(window.rowsBetween(W.unboundedPreceding, -rows))
            gone = F.count("median_price_cents").over(window.rowsBetween(W.unboundedPreceding, -rows))
            total = running - F.coalesce(dropped, F.lit(0))
            return F.try_divide(total.cast("double"), (known - gone).cast("double"))

        return build

    return with_frames(
        history, ["item_id"], order, LONG_ROWS,
        {"rolling_30d": mean_of(SHORT_ROWS), "rolling_90d": mean_of(LONG_ROWS)}, limit,
    )


def macro_baselines(history: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """One analysis record per item with history.

    Only the newest 90 rows per item are shuffled for the averages; the support floor works on
    counts per distinct price.
    """
    tail = newest_rows(history, ties)
    floor = exact_quantile(history.select("item_id", "median_price_cents"), ["item_id"],
                           "median_price_cents", FLOOR_QUANTILE, "_floor")
    return _analysed(tail, floor)


def newest_rows(history: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """The newest 90 rows per item, numbered by ``rn``."""
    ties = ties or []
    newest = [F.col(c).desc() for c in ["sale_date", *ties]]
    columns = dict.fromkeys(["item_id", "sale_date", *ties, "median_price_cents", "volume_sold"])
    return latest_rows(history.select(*columns), "item_id", newest, LONG_ROWS, "rn")


def _analysed(tail: DataFrame, floor: DataFrame) -> DataFrame:
    """Analysis records from the newest rows and the support floor with its number of rows."""
    price, recent = F.col("median_price_cents"), F.col("rn") <= SHORT_ROWS
    recent_price = F.when(recent, price)
    summary = tail.groupBy("item_id").agg(
        F.max(F.when(F.col("rn") == 1, price)).alias("latest_price_cents"),
        F.avg(recent_price).alias("r30"),
        F.avg(price).alias("r90"),
        F.count(recent_price).alias("_n"),
        F.sum(recent_price).alias("_s"),
        F.sum(recent_price * recent_price).alias("_ss"),
        F.avg(F.when(recent, F.col("volume_sold"))).alias("_volume"),
    )
    r30, r90 = F.col("r30"), F.col("r90")
    volatility = half_even(F.coalesce(F.sqrt(sample_variance(F.col("_n"), F.col("_s"), F.col("_ss"))), F.lit(0.0)))
    latest = F.col("latest_price_cents")
    return (
        summary.join(floor, "item_id", "left")
        .withColumn("volatility_cents", volatility)
        .select(
            "item_id",
            "latest_price_cents",
            half_even(r30).alias("rolling_30d_avg_cents"),
            half_even(r90).alias("rolling_90d_avg_cents"),
            F.when(r90 != 0, (r30 - r90) / r90 * 100).otherwise(F.lit(0.0)).alias("drift_percent"),
            "volatility_cents",
            F.coalesce("_volume", F.lit(0.0)).alias("avg_volume_30d"),
            F.coalesce(half_even(F.col("_floor")), latest).alias("support_floor_cents"),
            _ratio(F.col("volatility_cents"), latest).alias("cv_latest"),
            F.coalesce("n", F.lit(0)).alias("total_points_analyzed"),
        )
    )


class Summary(NamedTuple):
    """What the baselines of a history need of it, small enough to keep and to merge with that of later rows."""

    tail: DataFrame  # the newest 90 rows per item
    prices: DataFrame  # item_id, median_price_cents, times: rows per distinct price


def summarize(history: DataFrame, ties: list[str] | None = None) -> Summary:
    """The mergeable summary of some rows of a history."""
    prices = history.groupBy("item_id", "median_price_cents").agg(F.count(F.lit(1)).alias("times"))
    return Summary(newest_rows(history, ties).drop("rn"), prices)


def merged_prices(prices: DataFrame) -> DataFrame:
    """One row per item and price from several summaries."""
    return prices.groupBy("item_id", "median_price_cents").agg(F.sum("times").alias("times"))


def baselines_of(parts: Summary, ties: list[str] | None = None) -> DataFrame:
    """``macro_baselines`` of all rows behind the summaries, merged or not."""
    floor = exact_quantile(parts.prices, ["item_id"], "median_price_cents", FLOOR_QUANTILE, "_floor", times="times")
    return _analysed(newest_rows(parts.tail, ties), floor)


def fold_history(spark: SparkSession, root: str, epoch: int, new: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Adds the rows of refresh number ``epoch`` to the summaries below ``root``; returns the baselines of all rows so far.

    Only ``new`` is read of the history. Each refresh appends its own summary as a run; runs are merged by size, so their bytes
    stay near one summary of each item. A refresh that runs again replaces its run; refreshes are numbered without gaps. ``new`` has
    the columns ``item_id, sale_date, median_price_cents, volume_sold`` and ``ties``, with the same types in every refresh.
    """
    own = summarize(new, ties)
    ddls = [", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema) for part in own]
    merges = [lambda rows: newest_rows(rows, ties).drop("rn"), merged_prices]
    read = []
    for name, part, ddl, merge in zip(Summary._fields, own, ddls, merges):
        folder = f"{root}/{name}"
        compact_runs(spark, folder, epoch, ddl, merge=merge)
        append_run(part, folder, epoch)
        read.append(read_runs(spark, folder, epoch + 1, ddl).drop("run_last"))
    return baselines_of(Summary(*read), ties)


def _ratio(volatility: Column, base: Column) -> Column:
    usable = (base > 0) & (volatility > 0)
    return F.when(usable, F.try_divide(volatility.cast("double"), base.cast("double"))).otherwise(F.lit(0.0))


def monthly_seasonality(history: DataFrame) -> DataFrame:
    """Mean price per item and calendar month."""
    return history.groupBy("item_id", F.month("sale_date").cast("bigint").alias("month")).agg(
        F.avg("median_price_cents").alias("mean_price_cents")
    )


def seasonality_maps(history: DataFrame) -> DataFrame:
    """The same as one map per item; a group has at most twelve entries."""
    entry = F.struct(F.col("month").cast("int"), F.col("mean_price_cents"))
    return monthly_seasonality(history).groupBy("item_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("monthly_seasonality")
    )


def top_drift(baselines: DataFrame) -> DataFrame:
    """The item with the highest drift; the lower id wins a tie."""
    return baselines.orderBy(F.desc("drift_percent"), "item_id").limit(1).select("item_id", "drift_percent")


def limit_items(items: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` items by id; all of them for None or n <= 0."""
    return items.orderBy("id").limit(n) if n is not None and n > 0 else items


def upsert_baselines(new: DataFrame, old: DataFrame, now: Column) -> DataFrame:
    """Replace the row of each analysed item, keep all others."""
    fresh = stored(new.select(*BASELINE_FIELDS, now.alias("updated_at")))  # used twice
    kept = old.select(*BASELINE_FIELDS, "updated_at").join(fresh.select("item_id"), "item_id", "left_anti")
    return fresh.unionByName(kept)


def publish_baselines(items: DataFrame, baselines: DataFrame) -> DataFrame:
    """Name-keyed lookup used by the hot path, with the payload as JSON."""
    named = baselines.join(items.select(F.col("id").alias("item_id"), "market_hash_name"), "item_id")
    average, volatility = F.col("rolling_30d_avg_cents"), F.col("volatility_cents")
    cv = F.when((average != 0) & (volatility != 0),
                F.try_divide(volatility.cast("double"), average.cast("double")))
    fields = ["support_floor_cents", "latest_price_cents", "rolling_30d_avg_cents", "volatility_cents",
              "drift_percent"]
    rows = named.select("market_hash_name", *fields, F.coalesce(cv, F.lit(0.0)).alias("cv_published"))
    payload = F.to_json(F.struct(*fields, F.bround("cv_published", 4).alias("coefficient_of_variation")))
    return rows.withColumn("payload_json", payload)


def publish_sticker_prices(items: DataFrame, baselines: DataFrame) -> DataFrame:
    """Sticker name to latest price; prices are text in the lookup, as the hot path parses them."""
    stickers = items.filter(F.col("item_type") == "Sticker").select(F.col("id").alias("item_id"), "market_hash_name")
    return stickers.join(baselines.select("item_id", "latest_price_cents"), "item_id").select(
        F.col("market_hash_name").alias("name"), F.col("latest_price_cents").cast("string").alias("price")
    )


def macro_refresh(items: DataFrame, history: DataFrame, old: DataFrame, now: Column,
                  n_items: int | None = None, ties: list[str] | None = None) -> DataFrame:
    """Baselines of the first ``n_items`` items (all by default), merged into the stored ones."""
    if n_items is not None and n_items > 0:
        chosen = limit_items(items, n_items).select(F.col("id").alias("item_id"))
        history = lookup(history, chosen, "item_id", "inner")
    return upsert_baselines(macro_baselines(history, ties), old, now)
