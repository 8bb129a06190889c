"""Ordered work on groups of any size.

A window partition is one task, so a key that holds a large share of the rows would end up in
one executor. The helpers here first check the largest group. Within the limit, the plain
window over the key is used. Beyond it, rows are range-partitioned by (key, order), which cuts
a hot key into many partitions, and the pieces are stitched with per-partition summaries whose
number is bounded by the partition count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickscope.session import checkpointed

# Largest group one window task may sort.
GROUP_ROWS = 2_000_000

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the most frequent key; counts are combined before the shuffle."""
    sizes = df.groupBy(*keys).count() if keys else df.groupBy().count()
    return sizes.agg(F.max("count")).first()[0] or 0


def stage_ordered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range-partition and sort by (keys, order), with ``_part`` and ``_pos`` of every row.

    The result is checkpointed: range bounds are sampled, so partition numbers are only
    dependable once written.
    """
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    staged = checkpointed(placed.withColumn("_slot", F.monotonically_increasing_id()))
    return (
        staged.withColumn("_part", F.shiftright("_slot", _PART_BITS))
        .withColumn("_pos", F.col("_slot").bitwiseAND(F.lit((1 << _PART_BITS) - 1)))
        .drop("_slot")
    )


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], name: str, limit: int = GROUP_ROWS, largest: int | None = None
) -> DataFrame:
    """Dense row number from 1 per key (or over everything when ``keys`` is empty)."""
    if (largest_group(df, keys) if largest is None else largest) <= limit:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    staged = stage_ordered(df, keys, order)
    local = W.partitionBy("_part", *keys).orderBy("_pos")
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # only the first key of a partition can continue an earlier one, so this has at most
    # one row per partition and is safe to broadcast
    carried = (
        staged.groupBy("_part", *keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(earlier))
        .filter("_before > 0")
        .drop("_n")
    )
    numbered = staged.withColumn("_local", F.row_number().over(local)) if keys else staged.withColumn(
        "_local", F.col("_pos") + 1
    )
    match = [F.col("s._part") == F.col("c._part")] + [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    joined = numbered.alias("s").join(F.broadcast(carried.alias("c")), match, "left")
    return joined.select(
        *[F.col(f"s.{c}") for c in df.columns],
        (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name),
    )


def with_frames(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    back: int,
    columns: dict[str, object],
    limit: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add window columns that look back at most ``back`` rows within a key.

    ``columns`` maps a name to a function of the window spec (ordered, without a frame). A key
    beyond ``limit`` is cut into runs of ``limit`` rows; each run also receives the ``back``
    rows before it, which are dropped after the window. ``largest`` is the size of the largest
    group where the caller already knows a bound.
    """
    if (largest_group(df, keys) if largest is None else largest) <= limit:
        window = W.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: build(window) for name, build in columns.items()})
    run = max(limit, back)
    numbered = number_rows(df, keys, order, "_rn", limit, largest)
    own = F.expr(f"(_rn - 1) div {run}")
    tail = F.col("_rn") % run
    needed_next = (tail == 0) | (tail > run - back)
    copies = F.when(needed_next, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_own", own).withColumn("_run", F.explode(copies))
    window = W.partitionBy(*keys, "_run").orderBy("_rn")
    framed = spread.withColumns({name: build(window) for name, build in columns.items()})
    return framed.filter("_run = _own").drop("_rn", "_own", "_run")


def latest_rows(df: DataFrame, key: str, order: list[Column], n: int, name: str, lanes: int = 64) -> DataFrame:
    """The last ``n`` rows per key, numbered from the newest.

    Each map task keeps only its own top ``n`` before the shuffle; the lane spreads a hot key
    over several reducers before the final cut.
    """
    laned = df.withColumn("_lane", F.spark_partition_id() % lanes)
    for group in ([key, "_lane"], [key]):
        laned = laned.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
        laned = laned.filter(F.col(name) <= n)
    return laned.drop("_lane")
