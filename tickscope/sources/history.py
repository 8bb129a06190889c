"""Per-item history files: one CSV per item, the item name percent-encoded in the file name."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.functions.names import item_name, item_type
from tickscope.functions.pricing import to_cents
from tickscope.operators.joins import lookup
from tickscope.session import stored
from tickscope.sources.files import list_files, read_lines

# Cell texts that read as missing.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


# Timestamps beyond what nanoseconds in 64 bits can hold (the years 1677 to 2262) spoil a file.
LAST_SECOND = 9_223_372_036.0


class HistoryLoad(NamedTuple):
    accepted: DataFrame
    rejected_files: DataFrame


def with_identity(files: DataFrame) -> DataFrame:
    """Item name and type from ``file_name``."""
    named = files.withColumn("market_hash_name", item_name(F.col("file_name")))
    return named.withColumn("item_type", item_type(F.col("market_hash_name")))


# A cell of a line with quotes, after its comma: quoted up to the next comma or the end, or as it stands.
CELL = r',("[^"]*+(?:""[^"]*+)*+"(?=,|$)|[^,]*+)'


def cells_of(line: Column) -> Column:
    """The cells of a line of CSV, as many as it has; a doubled quote within quotes stands for one.

    A quote that nothing closes before a comma or the end is a plain character.
    """
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    plain = F.transform(quoted, lambda c: F.when(c.rlike('(?s)^".*"$'), inner(c)).otherwise(c))
    return F.when(line.contains('"'), plain).otherwise(F.split(line, ","))


def read_history_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all files, as text, with the item identity; the files are scanned once.

    That scan cuts each line into its cells and writes them as a table, with the places of the four names where a line
    holds them all. The header of a file is the first such line; its places are
    looked up for the files in which they are unusual. Columns may stand anywhere and lines may have any number of cells.
    The header stays a row, marked in ``is_header``: files without the four names can then be told apart without
    a second pass. Blank lines are skipped; a missing cell at the end of a line is null. Tasks list and open the files, in
    ``folder`` and below, so the driver holds no list of them.
    """
    value = F.col("value")
    lines = read_lines(spark, folder, ".csv").filter(value.rlike(r"[^\x00-\x20]")).select(
        cells_of(value).alias("_cells"), "file_name", F.col("place").alias("_line"))
    titles = F.transform("_cells", lambda t: F.trim(t))  # F.trim itself would take the place as its second argument
    places = F.array(*[F.array_position(titles, c).cast("int") for c in schemas.HISTORY_COLUMNS])
    may_be = F.forall(F.array(*map(F.lit, schemas.HISTORY_COLUMNS)), lambda c: F.array_contains(titles, c))
    table = stored(lines.withColumn("_places", F.when(may_be, places)))
    usual = range(1, len(schemas.HISTORY_COLUMNS) + 1)
    # one row per file with an unusual header
    odd = table.filter(F.col("_places").isNotNull()).groupBy("file_name").agg(
        F.min_by("_places", "_line").alias("_places")
    ).filter(F.col("_places") != F.array(*map(F.lit, usual)))
    placed = lookup(table.select("file_name", "_cells"), odd, "file_name", derived=True)
    named = [
        F.get("_cells", F.coalesce(F.get("_places", F.lit(k)), F.lit(k + 1)) - 1).alias(c)
        for k, c in enumerate(schemas.HISTORY_COLUMNS)
    ]
    return with_identity(mark_headers(placed.select(*named, "file_name")))


def mark_headers(raw: DataFrame) -> DataFrame:
    cells = [F.trim(F.col(f"`{c}`")).eqNullSafe(F.lit(c)) for c in schemas.HISTORY_COLUMNS]
    return raw.withColumn("is_header", cells[0] & cells[1] & cells[2] & cells[3])


def list_history_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files with their length, empty ones too; the content is not read, and the driver holds no list of them."""
    return with_identity(list_files(spark, folder, ".csv").select("file_name", "length"))


def _missing(name: str) -> Column:
    cell = F.col(f"`{name}`")
    return cell.isNull() | F.trim(cell).isin(MISSING)


def _number(name: str) -> Column:
    """The number a cell holds, or null. A number ends in a digit or a point; words and the
    spellings ``1.5d`` or ``Infinity``, which the cast would take, do not."""
    cell = F.col(f"`{name}`")
    return F.when(F.ascii(F.right(F.trim(cell), F.lit(1))) <= ord("9"), cell.try_cast("double"))


def clean_history(raw: DataFrame) -> DataFrame:
    """Rows with a numeric timestamp within range, typed: sale date, cents (ties to even), whole quantity.

    A price or quantity beyond the integers is null here; ``file_checks`` rejects its file.
    """
    seconds = _number("unix timestamp")
    rows = raw.filter(~F.col("is_header")) if "is_header" in raw.columns else raw
    kept = [c for c in raw.columns if c not in (*schemas.HISTORY_COLUMNS, "is_header")]
    return rows.filter(F.abs(seconds) <= LAST_SECOND).select(
        *kept,
        F.timestamp_seconds(seconds).alias("sale_date"),
        to_cents(_number("price")).alias("median_price_cents"),
        _number("quantity").try_cast("bigint").alias("volume_sold"),
    )


def file_checks(raw: DataFrame) -> DataFrame:
    """Per file: header found, rows, usable rows, and whether its content must be rejected.

    A price that is text anywhere spoils the file. On usable rows a missing price, a missing
    quantity, a number or timestamp out of range, or, once the quantity column holds text, a quantity that is
    not an integer does too.
    """
    row = ~F.col("is_header")
    quantity = F.col("quantity")
    # one pass that parses every cell once; the aggregate then only looks at flags
    flags = raw.select(
        "file_name", "is_header", row.alias("row"), (row & _number("unix timestamp").isNotNull()).alias("usable"),
        _missing("price").alias("no_price"), (_number("price").isNull() & ~_missing("price")).alias("text_price"),
        _missing("quantity").alias("no_quantity"),
        (_number("quantity").isNull() & ~_missing("quantity")).alias("text_quantity"),
        (quantity.contains(".") | quantity.try_cast("bigint").isNull()).alias("odd_quantity"),
        (
            (F.abs(_number("unix timestamp")) > LAST_SECOND)
            | (_number("price").isNotNull() & to_cents(_number("price")).isNull())
            | (_number("quantity").isNotNull() & _number("quantity").try_cast("bigint").isNull())
        ).alias("too_large"),
    )

    def anywhere(condition: str) -> Column:
        return F.coalesce(F.bool_or(F.expr(condition)), F.lit(False))

    grouped = flags.groupBy("file_name").agg(
        anywhere("is_header").alias("has_header"),
        F.count_if("row").alias("rows"),
        F.count_if("usable").alias("clean_rows"),
        anywhere("row AND text_price").alias("_text_price"),
        anywhere("usable AND no_price").alias("_no_price"),
        anywhere("usable AND no_quantity").alias("_no_quantity"),
        anywhere("row AND text_quantity").alias("_text_quantity"),
        anywhere("usable AND coalesce(odd_quantity, true)").alias("_odd_quantity"),
        anywhere("usable AND coalesce(too_large, false)").alias("_too_large"),
    )
    bad_values = F.col("_text_price") | F.col("_no_price") | F.col("_no_quantity") | F.col("_too_large") | (
        F.col("_text_quantity") & F.col("_odd_quantity")
    )
    # values only matter once there are usable rows
    rejected = ~F.col("has_header") | ((F.col("clean_rows") > 0) & bad_values)
    return grouped.select("file_name", "has_header", "rows", "clean_rows", rejected.alias("rejected"))


def load_history(raw: DataFrame) -> HistoryLoad:
    """Rows of good files and the rejected files; one bad value rejects its whole file."""
    # one row per bad file, found in a pass of its own: whole files stand or fall
    rejected = stored(file_checks(raw).filter("rejected").select("file_name"))
    accepted = clean_history(raw.join(rejected, "file_name", "left_anti"))
    return HistoryLoad(accepted, rejected)


def files_to_register(files: DataFrame, rejected: DataFrame) -> DataFrame:
    """Names that get an item: every file that has bytes and was not rejected, rows or not."""
    usable = files.filter(F.col("length") > 0) if "length" in files.columns else files
    return usable.join(rejected, "file_name", "left_anti").select("market_hash_name")


def write_history(accepted: DataFrame, items: DataFrame, path: str, truncate: bool = False) -> None:
    """Append (or replace) the price table, clustered by item so that readers can skip row groups.

    Rows are range-partitioned by (item, date): a hot item spreads over many files.
    """
    table = items.select("market_hash_name", F.col("id").alias("item_id"))
    rows = lookup(accepted, table, "market_hash_name", "inner").select(
        "item_id", "sale_date", "median_price_cents", "volume_sold"
    )
    clustered = rows.repartitionByRange("item_id", "sale_date").sortWithinPartitions("item_id", "sale_date")
    clustered.write.mode("overwrite" if truncate else "append").parquet(path)

