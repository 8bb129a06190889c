"""Exact per-key quantiles of integer values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_BITS = 12


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str, times: str | None = None) -> DataFrame:
    """(keys, ``name``, ``n``): linearly interpolated quantile ``q`` of a BIGINT column.

    Nulls in the value or the keys are left out. ``times`` names a column that says how often a row counts.

    Rows are first counted per distinct value, which the map side combines. Buckets of 2^12
    neighbouring values then show where the wanted rank lies, and only those buckets are
    ordered by value. No task ever holds all rows of a key.
    """
    # the null checks the join would add to one branch only are spelled out, so that both uses
    # of the counts share one scan and one exchange
    bucket = F.shiftright(value, BUCKET_BITS)
    present = df
    for column in (F.col(value), bucket, *map(F.col, keys)):
        present = present.filter(column.isNotNull())
    number = F.count(F.lit(1)) if times is None else F.sum(times)
    counted = present.groupBy(*keys, value).agg(number.alias("_c")).withColumn("_bucket", bucket)
    per_key = W.partitionBy(*keys)
    running = per_key.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    rank = (F.col("n") - 1) * F.lit(float(q))
    wanted = (
        counted.groupBy(*keys, "_bucket")
        .agg(F.sum("_c").alias("_size"))
        .withColumn("n", F.sum("_size").over(per_key))
        .withColumn("_base", F.coalesce(F.sum("_size").over(running), F.lit(0)))
        .withColumn("_low", F.floor(rank))
        .withColumn("_high", F.ceil(rank))
        .withColumn("_part", rank - F.floor(rank))
        .filter("_base <= _high AND _low < _base + _size")
        .drop("_size")
    )
    before = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum("_c").over(before), F.lit(0))

    def at(position: str):
        covered = (F.col("_start") <= F.col(position)) & (F.col(position) < F.col("_start") + F.col("_c"))
        return F.max(F.when(covered, F.col(value)))

    # interpolated from the nearer end, so that the result does not drift at the upper one
    low, high, part = F.col("_low_value"), F.col("_high_value"), F.col("_part")
    blend = F.when(part >= 0.5, high - (high - low) * (1 - part)).otherwise(low + (high - low) * part)
    return (
        counted.join(wanted, [*keys, "_bucket"])
        .withColumn("_start", start)
        .groupBy(*keys)
        .agg(at("_low").alias("_low_value"), at("_high").alias("_high_value"),
             F.max("_part").alias("_part"), F.max("n").alias("n"))
        .select(*keys, blend.alias(name), "n")
    )
