"""A table that grows by micro-batches, kept as runs of growing sizes.

Every micro-batch appends one run, ``<folder>/epoch=<n>``. Runs are merged ``FAN_IN`` at a time into
``<folder>.merged/run=<first>-<last>``, and merged runs again, so a reader opens at most ``FAN_IN - 1`` runs of each size,
however many micro-batches there were, and a row is rewritten once per size.

A run counts once Spark has committed it (``_SUCCESS``), and a run inside a wider committed one does not count. So a crash between a
merge and the removal of its parts loses and repeats nothing. Merges cover only micro-batches before the current one, which the stream has committed:
a micro-batch that runs again sees what it saw before.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN_IN = 8


class Run(NamedTuple):
    first: int
    last: int
    path: str


def committed_runs(spark: SparkSession, folder: str, epoch: int) -> list[Run]:
    """All committed runs of micro-batches before ``epoch``, the ones inside wider ones included; two listings."""
    jvm = spark.sparkContext._jvm
    found = []
    for pattern in (f"{folder}/epoch=*/_SUCCESS", f"{folder}.merged/run=*/_SUCCESS"):
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in store.globStatus(path) or []:
            parent = status.getPath().getParent()
            ends = parent.getName().split("=")[1].split("-")
            found.append(Run(int(ends[0]), int(ends[-1]), parent.toString()))
    return sorted((r for r in found if r.last < epoch), key=lambda r: (r.first, -r.last))


def live_runs(runs: list[Run]) -> list[Run]:
    """The runs that no other one covers, in order. Runs are nested or apart, never partly overlapping."""
    live: list[Run] = []
    for run in runs:  # by first epoch, wider ones first
        if not live or run.first > live[-1].last:
            live.append(run)
    return live


def read_runs(spark: SparkSession, folder: str, epoch: int, ddl: str, partition: str | None = None) -> DataFrame:
    """The rows of all micro-batches before ``epoch``, with ``run_last``, the last epoch of a row's run.

    ``partition`` names a partition column of type STRING inside each run; a filter on it skips folders.
    """
    return _rows(spark, folder, live_runs(committed_runs(spark, folder, epoch)), ddl, partition)


def _rows(spark: SparkSession, folder: str, runs: list[Run], ddl: str, partition: str | None) -> DataFrame:
    """One scan for the runs of single micro-batches and one for the merged ones."""
    full = f"{ddl}, {partition} STRING" if partition else ddl
    found = spark.createDataFrame([], f"{full}, run_last BIGINT")
    kinds = [(folder, "epoch", "BIGINT", F.col("epoch")),
             (f"{folder}.merged", "run", "STRING", F.substring_index("run", "-", -1).cast("bigint"))]
    for base, name, kind, last in kinds:
        paths = [r.path for r in runs if r.path.rsplit("/", 1)[1].startswith(f"{name}=")]
        if paths:
            part = spark.read.schema(f"{full}, {name} {kind}").option("basePath", base).parquet(*paths)
            found = found.unionByName(part.withColumn("run_last", last).drop(name))
    return found


def append_run(df: DataFrame, folder: str, epoch: int, partition: str | None = None) -> None:
    """Writes the run of one micro-batch; a second attempt replaces the first."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{folder}/epoch={epoch}")


def compact_runs(
    spark: SparkSession,
    folder: str,
    epoch: int,
    ddl: str,
    partition: str | None = None,
    merge: Callable[[DataFrame], DataFrame] | None = None,
    fan_in: int = FAN_IN,
) -> list[Run]:
    """Merges the runs before ``epoch`` that fill a size, and removes what merged runs cover.

    Called at the start of micro-batch ``epoch``. Widths are powers of ``fan_in`` and aligned, so all attempts at a micro-batch agree on the
    merge. ``merge`` may fold the rows (given with ``run_last``); without one they are kept as they are. Returns the live runs.
    """
    width = fan_in
    while epoch % (width * fan_in) == 0 and width * fan_in <= epoch:
        width *= fan_in
    runs = committed_runs(spark, folder, epoch)
    if epoch and epoch % width == 0:
        first = epoch - width
        inside = [r for r in live_runs(runs) if r.first >= first]
        if len(inside) > 1:
            rows = _rows(spark, folder, inside, ddl, partition)
            merged = (merge(rows) if merge else rows).drop("run_last")
            target = f"{folder}.merged/run={first}-{epoch - 1}"
            writer = merged.repartition(partition).write.partitionBy(partition) if partition else merged.write
            writer.mode("overwrite").parquet(target)
            runs = committed_runs(spark, folder, epoch)
    live = live_runs(runs)
    for run in set(runs) - set(live):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return live
