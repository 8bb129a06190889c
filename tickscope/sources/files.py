"""Folders with any number of files: listed and read by tasks, so no list of files comes to the driver.

Spark's own file sources keep the names of all files, and a description of each, in the driver. Here a listing is a table,
and tasks open the files through ``pyarrow.fs`` (local paths, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickscope.session import stored

BLOCK_BYTES = 16 << 20  # a larger file is read by several tasks
TASK_BYTES = 64 << 20
TASK_BLOCKS = 2000  # files or blocks one task reads
BATCH_LINES = 20_000
BATCH_BYTES = 8 << 20


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if folder.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def _entries(folder: str):
    """Function for ``mapInArrow`` over paths of folders: their files and folders."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(folder)[0]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = [e for e in store.get_file_info(fs.FileSelector(path)) if not e.base_name.startswith((".", "_"))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([e.path for e in found], pa.string()), pa.array([e.size or 0 for e in found], pa.int64()),
                    pa.array([e.type == fs.FileType.Directory for e in found], pa.bool_())], ["path", "length", "is_folder"])

    return entries


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """``path, file_name, length`` of all files with this suffix in ``folder`` and the folders below it.

    Level by level, with the folders of a level dealt over tasks; one folder is listed by one task. Names that begin with
    a point or an underscore are left out, as Spark does.
    """
    tasks, found = 4 * spark.sparkContext.defaultParallelism, []
    level = spark.createDataFrame([(store_of(folder)[1],)], "path STRING")
    while True:
        listed = stored(level.mapInArrow(_entries(folder), "path STRING, length BIGINT, is_folder BOOLEAN"))
        found.append(listed.filter(~F.col("is_folder") & F.endswith("path", F.lit(suffix))))
        level = listed.filter("is_folder").select("path").repartition(tasks)
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).select("path", F.substring_index("path", "/", -1).alias("file_name"), "length")


def _cut(file, at: int, size: int) -> int:
    """Where the first line that starts at ``at`` or later starts; the end where there is none."""
    if at == 0 or at >= size:
        return min(at, size)
    at -= 1
    while at < size:
        piece = file.read_at(min(1 << 16, size - at), at)
        if not piece:
            break
        if (found := piece.find(b"\n")) >= 0:
            return at + found + 1
        at += len(piece)
    return size


def _reader(folder: str, block: int):
    """Function for ``mapInArrow`` over ``path, file_name, start``: the lines that start in the block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(folder)[0]
        names, places, values, held = [], [], [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.binary())],
                ["file_name", "place", "value"])

        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as file:
                    size = file.size()
                    first, last = (_cut(file, at, size) for at in (row["start"], row["start"] + block))
                    data = file.read_at(last - first, first) if last > first else b""
                if first == 0:
                    data = data.removeprefix(b"\xef\xbb\xbf")
                for n, line in enumerate(data.splitlines()):
                    names.append(row["file_name"])
                    places.append(row["start"] + n)
                    values.append(line)
                    held += len(line)
                    if len(values) >= BATCH_LINES or held >= BATCH_BYTES:
                        yield batch_of()
                        names, places, values, held = [], [], [], 0
        if values:
            yield batch_of()

    return read


def read_lines(spark: SparkSession, folder: str, suffix: str, block: int = BLOCK_BYTES) -> DataFrame:
    """``file_name, place, value`` of every line of the files ``list_files`` finds; ``place`` ascends along a file.

    Lines end as in Spark's text source, and a byte order mark is left out. Files beyond ``block`` bytes are cut after
    a newline, so tasks share them.
    """
    files = stored(list_files(spark, folder, suffix).filter("length > 0"))
    blocks = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block).cast("bigint"))))
    size = files.agg(F.sum("length").alias("b"), F.sum(F.ceil(F.col("length") / block)).alias("n")).first()
    tasks = max((size.b or 0) // TASK_BYTES, (size.n or 0) // TASK_BLOCKS, spark.sparkContext.defaultParallelism)
    lines = blocks.select("path", "file_name", "start").repartition(tasks).mapInArrow(
        _reader(folder, block), "file_name STRING, place BIGINT, value BINARY")
    return lines.withColumn("value", F.col("value").cast("string"))
