"""Joins of tables that are laid out in buckets of the key once and then meet without a shuffle."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.session import ensure_checkpoint_dir, stored

BUCKET_ROWS = 2_000_000  # rows of a bucket, about
LEAST_BUCKETS = 8
# A key with more rows than this share of a bucket is spread over several buckets.
HOT_SHARE = 4
SALTS = 1 << 20


class Layout(NamedTuple):
    """How rows of a key are dealt: ``buckets``, and the keys that are spread (``key, _parts``)."""

    key: str
    buckets: int
    hot: DataFrame


def layout_for(facts: DataFrame, key: str, bucket_rows: int = BUCKET_ROWS) -> Layout:
    """The layout that keeps buckets of ``facts`` at about ``bucket_rows`` rows.

    Keys above a quarter of a bucket are hot; there are at most four per bucket, so their table is small. Counts are combined
    before they are shuffled. An empty table gets the least number of buckets; null keys are never hot here.
    """
    counts = stored(facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    rows = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    limit = max(1, bucket_rows // HOT_SHARE)
    hot = counts.filter(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / F.lit(limit)).cast("bigint").alias("_parts"))
    return Layout(key, max(LEAST_BUCKETS, -(-rows // bucket_rows)), stored(hot))


def bucketed_facts(facts: DataFrame, layout: Layout) -> DataFrame:
    """``facts`` written in buckets of (key, ``_salt``) to the shared folder and read from there.

    Rows of a hot key take one of its ``_parts`` salts and rows without a key, which meet nothing, any salt, so neither gathers in
    one bucket. The salt depends on the row and its input partition only: a task that runs again repeats it.
    """
    dealt = F.xxhash64(F.spark_partition_id(), *facts.columns)
    spread = facts.withColumn("_deal", dealt).join(F.broadcast(layout.hot), layout.key, "left")  # at most four keys a bucket
    salt = F.when(F.col(layout.key).isNull(), F.pmod("_deal", F.lit(SALTS))).otherwise(
        F.pmod("_deal", F.coalesce("_parts", F.lit(1).cast("bigint"))))
    return _written(spread.withColumn("_salt", salt).select(*facts.columns, "_salt"), layout)


def bucketed_lookup(table: DataFrame, layout: Layout) -> DataFrame:
    """A table with unique keys in the same buckets; the few rows of hot keys are repeated for each of their salts."""
    known = table.filter(F.col(layout.key).isNotNull()).join(F.broadcast(layout.hot), layout.key, "left")
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1).cast("bigint")) - 1)
    return _written(known.withColumn("_salt", F.explode(salts)).select(*table.columns, "_salt"), layout)


def colocated(facts: DataFrame, table: DataFrame, layout: Layout, how: str = "left") -> DataFrame:
    """The join of two tables of one layout, without an exchange on either side; ``_salt`` stays for further joins.

    ``how`` is left or inner. Rows without a key find nothing.
    """
    return facts.join(table.hint("merge"), [layout.key, "_salt"], how)


def _written(df: DataFrame, layout: Layout) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"bucketed_{uuid.uuid4().hex}"
    # dealt as the buckets are, so that each bucket is one file
    dealt = df.repartition(layout.buckets, layout.key, "_salt")
    (dealt.write.format("parquet").bucketBy(layout.buckets, layout.key, "_salt").sortBy(layout.key, "_salt")
     .option("path", f"{spark.sparkContext.getCheckpointDir()}/tables/{name}").saveAsTable(name))
    return spark.table(name)
