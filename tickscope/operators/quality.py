"""Reports on raw history files and integrity checks on the loaded price table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.operators.ordering import GROUP_ROWS, number_rows
from tickscope.sources.history import file_checks

# Which decoded names are shown.
FIRST_FILES, EVERY_FILE, MAX_SAMPLES = 4, 3000, 6


def validation_report(raw: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, files with dropped rows, dropped and kept rows.

    Files without a readable header count in the total only. Prices are not checked here.
    """
    readable = file_checks(raw).filter("has_header").select(
        "file_name", "clean_rows", (F.col("rows") - F.col("clean_rows")).alias("dropped")
    )
    return files.select("file_name").join(readable, "file_name", "left").agg(
        F.count(F.lit(1)).alias("files_total"),
        F.count_if(F.col("dropped") > 0).alias("files_with_drops"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("rows_dropped"),
        F.coalesce(F.sum("clean_rows"), F.lit(0)).alias("clean_rows"),
    )


def type_distribution(files: DataFrame) -> DataFrame:
    """Number of files per item type."""
    return files.groupBy("item_type").agg(F.count(F.lit(1)).alias("files"))


def sample_decodes(files: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Raw and decoded name of the first four and every 3000th file, at most six."""
    numbered = number_rows(files.select("file_name", "market_hash_name", "item_type"), [], ["file_name"], "idx", limit)
    chosen = numbered.filter((F.col("idx") <= FIRST_FILES) | (F.col("idx") % EVERY_FILE == 0))
    return chosen.orderBy("idx").limit(MAX_SAMPLES)


def integrity_scan(history: DataFrame) -> DataFrame:
    """Rows, date range, rows with a null, rows with an impossible value, in one scan."""
    columns = ["item_id", "sale_date", "median_price_cents", "volume_sold"]
    missing = F.col(columns[0]).isNull()
    for name in columns[1:]:
        missing = missing | F.col(name).isNull()
    return history.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("sale_date").alias("min_date"),
        F.max("sale_date").alias("max_date"),
        F.count_if(missing).alias("null_rows"),
        F.count_if((F.col("median_price_cents") <= 0) | (F.col("volume_sold") < 0)).alias("invalid_rows"),
    )


def duplicate_keys(history: DataFrame) -> DataFrame:
    """Number of (item, date) keys that occur more than once."""
    keys = history.groupBy("item_id", "sale_date").count()
    return keys.agg(F.count_if(F.col("count") > 1).alias("duplicate_keys"))


def mapping_coverage(items: DataFrame, history: DataFrame) -> DataFrame:
    """Items that have history, and all items."""
    known = history.select(F.col("item_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    return items.select("id").join(known, "id", "left").agg(
        F.count("_has").alias("items_with_history"), F.count(F.lit(1)).alias("items_total")
    )


def top_items_by_points(history: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` items with most rows; names are joined after the cut. Ties go to the lower id."""
    top = history.groupBy("item_id").agg(F.count(F.lit(1)).alias("points")).orderBy(F.desc("points"), "item_id").limit(n)
    names = items.select(F.col("id").alias("item_id"), "market_hash_name")
    return names.join(F.broadcast(top), "item_id")  # n rows
