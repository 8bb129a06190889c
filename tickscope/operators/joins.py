"""Lookups of a large table in one with unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.session import BROADCAST_ROWS, at_most, stored

# Keys served apart from the shuffle when the lookup table is too large to broadcast.
HOT_KEYS = 1000
SALTS = 1 << 20


def lookup(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    derived: bool = False,
    rows: int = BROADCAST_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Join ``facts`` to a table whose ``key`` is unique (``how``: left or inner).

    A table of at most ``rows`` rows and ``BROADCAST_BYTES`` bytes is broadcast, and the facts are not shuffled. A larger one
    is joined by shuffle. There, the ``hot_keys`` most frequent keys get their (few) table rows
    by broadcast and are salted in the shuffle, so no key gathers in one reducer.

    ``derived`` writes a computed table once, so that it is not computed for the size check and
    again for the join.
    """
    if derived:
        table = stored(table)
    if at_most(table, rows):
        return facts.join(F.broadcast(table), key, how)
    values = [c for c in table.columns if c != key]
    packed = table.select(key, F.struct(F.lit(True).alias("_hit"), *values).alias("_row"))
    hot = stored(
        facts.filter(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count"), key).limit(hot_keys)
    ).select(key)
    near = packed.join(F.broadcast(hot), key, "left_semi").withColumnRenamed("_row", "_near")  # at most hot_keys rows
    served = facts.join(F.broadcast(near), key, "left")
    # the salt only depends on the row and its input partition, so a rerun task repeats it
    spread = 1 + F.pmod(F.xxhash64(F.spark_partition_id(), *facts.columns), F.lit(SALTS))
    away = F.col("_near").isNotNull() | F.col(key).isNull()
    salted = served.withColumn("_salt", F.when(away, spread).otherwise(F.lit(0)))
    # always 0, but not a constant that the optimizer could drop from the join key
    far = packed.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(1)))
    joined = salted.join(far, [key, "_salt"], "left").withColumn("_found", F.coalesce("_near", "_row"))
    if how == "inner":
        joined = joined.filter(F.col("_found").isNotNull())
    others = [c for c in facts.columns if c != key]
    return joined.select(key, *others, *[F.col(f"_found.{c}").alias(c) for c in values])
