"""Reading, Arrow mapping and cell helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tickscope.session import stored

__all__ = ["bounded_batches", "give_back_memory", "local_roots", "map_cells", "read_table", "runs", "stored"]

# Rows of one Arrow batch when whole texts go to Python; a task holds a few such batches at a time.
BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds Arrow batches in rows and bytes, so that a run of very long texts does not fill a worker.

    It changes memory only: no operator's result depends on where a batch ends.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def give_back_memory() -> None:
    """Returns the free memory of a worker process to the system, where the C library and Arrow keep it for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_cells(cells: DataFrame, key: str, make: Callable[[], Callable[[pa.Table], Iterator[pa.RecordBatch]]],
              schema: str, partitions: int | None = None) -> DataFrame:
    """Runs the function that ``make`` gives each task once per value of ``key``, whose rows fit in memory by construction.

    Cells are dealt by their key and sorted, then streamed: a task holds one cell at a time, however
    many cells it gets, and thousands of tiny cells cost no job or Pandas group each.
    """
    dealt = cells.repartition(partitions, key) if partitions else cells.repartition(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for cell in runs(batches, key):
            yield from work(cell)

    return dealt.sortWithinPartitions(key).mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], key: str, limit: int | None = None) -> Iterator[pa.Table]:
    """Neighbouring rows with the same key as one table, or in tables of at most ``limit`` rows."""
    held: list[pa.RecordBatch] = []
    n_held = 0
    for batch in batches:
        cuts = [*_cuts(batch.column(key)), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if held and held[-1].column(key)[-1] != batch.column(key)[start]:
                yield pa.Table.from_batches(held)
                held, n_held = [], 0
            while start < end:
                upto = end if limit is None else min(end, start + limit - n_held)
                held.append(batch.slice(start, upto - start))
                n_held += upto - start
                start = upto
                if n_held == limit:
                    yield pa.Table.from_batches(held)
                    held, n_held = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _cuts(keys: pa.Array) -> list[int]:
    """Positions at which the key differs from the row before, with 0 first."""
    values = keys.to_numpy(zero_copy_only=False)
    if not len(values):
        return []
    return [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 linked by pairs (i, j): the least node of each node's component."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        np.minimum.at(root, root[i], least)
        root = root[root]
        open_pairs = root[i] != root[j]
        if not open_pairs.any():
            break
        i, j = i[open_pairs], j[open_pairs]
    while (root != root[root]).any():
        root = root[root]
    return root
