"""The six tables and the two published lookups as Parquet with fixed schemas.

There is no table format with merge here, so a changed table is written as a new snapshot
folder next to the old one; readers take the newest complete snapshot. A path is never
overwritten while a plan still reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickscope import schemas


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Newest snapshot of a table, empty when there is none yet."""
    version = latest_version(spark, root, table)
    if version is None:
        return spark.createDataFrame([], schemas.TABLES[table])
    return spark.read.schema(schemas.TABLES[table]).parquet(f"{root}/{table}/v={version:09d}")


def write_snapshot(df: DataFrame, root: str, table: str) -> int:
    """Write ``df`` as the next snapshot and return its number."""
    version = (latest_version(df.sparkSession, root, table) or 0) + 1
    columns = [f.name for f in _struct(df.sparkSession, table)]
    df.select(*columns).write.mode("overwrite").parquet(f"{root}/{table}/v={version:09d}")
    return version


def append_table(df: DataFrame, root: str, table: str) -> None:
    """Append to an insert-only table (prices, ticks, trades, ledger), which stays in one folder."""
    columns = [f.name for f in _struct(df.sparkSession, table)]
    df.select(*columns).write.mode("append").parquet(f"{root}/{table}/v={0:09d}")


def latest_version(spark: SparkSession, root: str, table: str) -> int | None:
    """Number of the newest committed snapshot."""
    return max(_committed(spark, f"{root}/{table}"), default=None)


def epochs_before(spark: SparkSession, folder: str, epoch: int) -> list[int]:
    """Committed ``epoch=<n>`` folders below ``epoch``, in order."""
    return sorted(n for n in _committed(spark, folder) if n < epoch)


def remove_epochs(spark: SparkSession, folder: str, epoch: int) -> None:
    """Removes the ``epoch=<n>`` folders below ``epoch``."""
    jvm = spark.sparkContext._jvm
    for old in epochs_before(spark, folder, epoch):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch={old}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _committed(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the ``name=<n>`` folders whose write was committed (Spark leaves ``_SUCCESS``)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # one call for all folders, not one for each
    marks = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "*=*/_SUCCESS")) or []
    return [int(status.getPath().getParent().getName().split("=")[1]) for status in marks]


def _struct(spark: SparkSession, table: str):
    return spark.createDataFrame([], schemas.TABLES[table]).schema
