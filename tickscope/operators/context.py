"""Market context: one wide pricing record per requested item, and baseline search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.functions import pricing
from tickscope.functions.names import base_name, version
from tickscope.functions.pricing import half_even, to_cents
from tickscope.operators.joins import lookup
from tickscope.operators.search import matching_items

LIVE_SOURCE = "skinport"


def steam_baseline(history: DataFrame) -> DataFrame:
    """Average historical price per item."""
    return history.groupBy("item_id").agg(F.avg("median_price_cents").alias("avg_steam"))


def source_baseline(ticks: DataFrame, source: str | None = LIVE_SOURCE) -> DataFrame:
    """Average tick price per item, of one source or of all."""
    chosen = ticks if source is None else ticks.filter(F.col("marketplace_source") == source)
    return chosen.groupBy("item_id").agg(F.avg("price_cents").alias("avg_source"))


def resolve_items(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Base item (required) and versioned item (falls back to the base) of each requested name."""
    parsed = requests.select(
        "market_hash_name", base_name(F.col("market_hash_name")).alias("base_name"),
        version(F.col("market_hash_name")).alias("version"),
    )
    base = items.select(F.col("market_hash_name").alias("base_name"), F.col("id").alias("base_id"), "item_type")
    exact = items.select("market_hash_name", F.col("id").alias("_exact"))
    found = lookup(lookup(parsed, base, "base_name", "inner"), exact, "market_hash_name")
    versioned = F.when(F.col("version").isNotNull(), F.coalesce("_exact", "base_id")).otherwise(F.col("base_id"))
    return found.withColumn("versioned_id", versioned).drop("_exact")


def pick_history_version(requests: DataFrame, sales: DataFrame) -> DataFrame:
    """Sales-history entry per (base_name, version): the matching version, else the first entry.

    ``sales`` has ``base_name``, ``pos`` and ``entry``. First entries and matching entries are
    two small aggregates, so the entries of a name are never gathered.
    """
    def first(keys: list[str], df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min_by("entry", "pos").alias(name))

    versioned = sales.select("base_name", F.col("entry.version").alias("version"), "pos", "entry")
    matching = first(["base_name", "version"], versioned.filter("version IS NOT NULL"), "_match")
    fallback = first(["base_name"], sales, "_first")
    wanted = requests.select("base_name", "version").distinct()
    return (
        wanted.join(matching, ["base_name", "version"], "left")
        .join(fallback, "base_name", "left")
        .select("base_name", "version", F.coalesce("_match", "_first").alias("entry"))
    )


def market_context(
    requests: DataFrame, items: DataFrame, history: DataFrame, ticks: DataFrame, baselines: DataFrame,
    sales: DataFrame, source: str = LIVE_SOURCE,
) -> DataFrame:
    """The 16-field pricing record of every requested, known item.

    History averages belong to the base item; ticks and baselines to the versioned one.
    """
    resolved = resolve_items(requests.select("market_hash_name").distinct(), items)
    entries = pick_history_version(resolved, sales)
    macro = baselines.select(
        F.col("item_id").alias("versioned_id"), F.lit(True).alias("_macro"), "latest_price_cents", "avg_volume_30d",
        "drift_percent", "volatility_cents", "support_floor_cents",
    )
    steam = steam_baseline(history).withColumnRenamed("item_id", "base_id")
    live = source_baseline(ticks, source).withColumnRenamed("item_id", "versioned_id")
    # aggregated to one row per item; a requested base item repeats once per version only
    joined = (
        resolved.join(steam, "base_id", "left").join(live, "versioned_id", "left").join(macro, "versioned_id", "left")
    )
    same_entry = (F.col("r.base_name") == F.col("e.base_name")) & F.col("r.version").eqNullSafe(F.col("e.version"))
    rows = joined.alias("r").join(entries.alias("e"), same_entry, "left").select("r.*", "e.entry")

    median = to_cents(pricing.recent_median(F.col("entry")))
    has_macro = F.coalesce("_macro", F.lit(False))
    staged = rows.select(
        "*",
        median.alias("median_cents"),
        pricing.downtrend(F.col("entry")).alias("trend"),
        pricing.discount_corridor(F.col("item_type")).alias("discount"),
        pricing.is_liquid(has_macro, F.col("latest_price_cents"), F.col("avg_volume_30d"),
                          F.col("item_type")).alias("is_liquid"),
    )
    reference = F.coalesce(F.col("median_cents").cast("double"), F.col("avg_source"))
    shifted = staged.withColumn("shift", pricing.regime_shift(F.col("avg_steam"), reference, F.col("discount")))
    priced = shifted.withColumn(
        "cash",
        pricing.cash_equivalent(F.col("is_liquid"), F.col("median_cents"), F.col("avg_steam"), F.col("avg_source"),
                                F.col("shift"), F.col("discount")),
    )
    return priced.select(
        "market_hash_name",
        half_even(F.col("avg_steam")).alias("historical_steam_avg_cents"),
        half_even(F.col("avg_source")).alias("historical_skinport_avg_cents"),
        F.col("median_cents").alias("real_time_skinport_median_cents"),
        F.col("cash").alias("cash_equivalent_avg_cents"),
        pricing.snipe_threshold(F.col("cash"), F.col("trend.detected"), F.col("trend.severity"))
        .alias("snipe_threshold_cents"),
        "item_type",
        "is_liquid",
        "avg_volume_30d",
        F.coalesce("drift_percent", F.lit(0.0)).alias("drift_percent"),
        F.coalesce("volatility_cents", F.lit(0)).alias("volatility_cents"),
        "support_floor_cents",
        F.col("shift").alias("regime_shift_detected"),
        F.coalesce("trend.detected", F.lit(False)).alias("downtrend_detected"),
        F.coalesce("trend.severity", F.lit(0.0)).alias("downtrend_severity"),
        F.col("entry.item_page").alias("item_page"),
        F.col("entry.market_page").alias("market_page"),
    )


def sticker_price(
    stickers: DataFrame, sales: DataFrame, items: DataFrame, history: DataFrame, ticks: DataFrame
) -> DataFrame:
    """Price per sticker ``name``: recent median, else history average, else average tick, else null."""
    names = stickers.select("name").distinct()
    first = sales.groupBy(F.col("base_name").alias("name")).agg(F.min_by("entry", "pos").alias("entry"))
    ids = items.select(F.col("market_hash_name").alias("name"), "id")
    keyed = names.join(first, "name", "left").join(ids, "name", "left").withColumnRenamed("id", "item_id")
    averaged = keyed.join(steam_baseline(history), "item_id", "left").join(
        source_baseline(ticks, None), "item_id", "left"
    )
    return averaged.select(
        "name",
        F.coalesce(to_cents(pricing.recent_median(F.col("entry"))), half_even(F.col("avg_steam")),
                   half_even(F.col("avg_source"))).alias("price_cents"),
    )


def search_baselines(items: DataFrame, baselines: DataFrame, query: str, limit: int = 10,
                     postings: DataFrame | None = None) -> DataFrame:
    """Baselines of the first ``limit`` items (by name) whose name contains ``query``, any case.

    ``%`` and ``_`` in the query act as wildcards. With ``postings`` (``search.name_postings``) only names with the
    query's trigrams are looked at. The cut comes before items without a
    baseline are left out, and before the join.
    """
    fields = ["drift_percent", "volatility_cents", "avg_volume_30d", "support_floor_cents", "latest_price_cents"]
    top = matching_items(items, query, postings).orderBy("market_hash_name").limit(limit)
    chosen = top.select(F.col("id").alias("item_id"), "market_hash_name")
    return baselines.select("item_id", *fields).join(F.broadcast(chosen), "item_id").select("market_hash_name", *fields)
