"""Embedding whitening with distributed block matrices: scatter by a block product, local eigenvectors, projection by another."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK_CELLS = 1 << 17  # numbers of one block: 1 MB
LARGEST = 2.0**52  # a scaled entry beyond this has no exact long
SPLIT_BLOCKS = 16  # row blocks that one task multiplies before partial products are added


def usable(vector: Column) -> Column:
    """Not null, not empty, and all entries finite and small enough for an exact integer."""
    entry_ok = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) * SCALE < LARGEST))  # NaN is above all numbers
    return F.coalesce(entry_ok & (F.size(vector) > 0), F.lit(False))


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the usable rows whose length is the commonest one (ties: the greater): ``floor(64 c) + 1000000``."""
    vector = F.col(f"`{vector_col}`")
    x = F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    rows = stored(vectors.where(usable(vector)).select(F.col(f"`{id_col}`").alias("vec_id"), x.alias("x")))
    length = rows.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first().m
    return rows if length is None else rows.where(F.size("x") == length.d)


@dataclass
class Whitening:
    rows: DataFrame  # index, vec_id, d (n * x - S)
    n: int
    values: np.ndarray  # eigenvalues, falling
    explained: np.ndarray
    projected: BlockMatrix | None


def _block_rows(dims: int) -> int:
    return max(1, BLOCK_CELLS // max(1, dims))


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left * right`` with the inner dimension cut into ``splits`` runs, so that no task receives a whole matrix."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose of a tall matrix times itself; its size is that of the vectors squared, whatever the number of rows."""
    blocks = -(-matrix.numRows() // matrix.rowsPerBlock)
    return _product(matrix.transpose(), matrix, max(1, -(-blocks // SPLIT_BLOCKS))).toLocalMatrix().toArray()


def _indexed(rows: DataFrame) -> DataFrame:
    """``index`` from 0 without gaps, by file and place in it: a rerun task numbers its rows alike, and nothing is sorted."""
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    sizes = placed.groupBy("file").agg((F.max("place") + 1).alias("n")).orderBy("file").collect()  # one row per written file
    starts, total = {}, 0
    for r in sizes:
        starts[r.file], total = total, total + r.n
    table = rows.sparkSession.createDataFrame(list(starts.items()), "file string, start long")
    return placed.join(F.broadcast(table), "file").withColumn("index", F.col("start") + F.col("place")).drop("file", "place", "start")


def _matrix(indexed: DataFrame, column: str, dims: int) -> BlockMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(indexed.select("index", array_to_vector(column).alias("vector")), "vector")
    return IndexedRowMatrix(vectors).toBlockMatrix(_block_rows(dims), dims)


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """Means, scatter and eigenvectors over all usable rows, and the rows projected on the whitening matrix.

    Sums are exact integers and a row enters as ``(n x - S) / n``, whose numerator is exact too, so nothing cancels. Rows become
    blocks of about a megabyte; the scatter matrix is a block product added up over runs of blocks. Only it (the square of the vectors'
    length) reaches the driver, for ``eigh``. ``None`` if no row is usable.
    """
    rows = integer_rows(vectors, id_col, vector_col)
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    dims = first.d
    # One aggregate of d sums, combined in each task; the rows are never exploded.
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[k].cast("decimal(20,0)")).alias(f"s{k}") for k in range(dims))).first()
    n, totals = sums.n, [int(sums[f"s{k}"]) for k in range(dims)]
    total = F.array(*(F.lit(t if abs(t) < 2**63 else None).cast("long") for t in totals))
    means = F.lit([t / n for t in totals])
    numerator = F.zip_with("x", total, lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(n).cast("long")), s))
    # Only entries too large for an exact numerator fall back to a rounded mean.
    rounded = F.zip_with("x", means, lambda x, m: x - m)
    centred = stored(rows.select("vec_id", numerator.alias("d"), rounded.alias("r")))
    indexed = _indexed(centred).withColumn("c", F.zip_with("d", "r", lambda v, r: F.coalesce(v / F.lit(float(n)), r)))
    matrix = _matrix(indexed, "c", dims)
    covariance = _scatter(matrix) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, axes = values[order], axes[:, order]
    # A direction without variance cannot be scaled to one.
    floor = max(float(values[0]), 0.0) * dims * np.finfo(float).eps * 8
    flat = values <= floor
    scales = np.where(flat, 0.0, 1.0 / np.sqrt(np.where(flat, 1.0, values)))
    trace = float(np.trace(covariance))
    explained = np.where(trace > 0, values / (trace or 1.0), 0.0)
    # The whitening matrix is one block of the vectors' length times ``components``.
    scaled = DenseMatrix(dims, len(order), (axes * scales).ravel(order="F").tolist())
    context = rows.sparkSession.sparkContext
    weights = BlockMatrix(context.parallelize([((0, 0), scaled)], 1), dims, len(order))
    values = np.where(flat, 0.0, values)
    return Whitening(indexed.drop("c", "r"), n, values, explained, _product(matrix, weights, 1))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``, one row per usable input row.

    ``whitened`` is the array of the row's values on the first ``components`` components (as many as the vectors have entries, if
    fewer), by falling eigenvalue; ``explained`` is the share of each in the trace. ``deviation`` is the exact sum of ``(n x - S)**2``, null
    beyond a long. ``identity_error`` is the largest entry of the whitened rows' covariance minus the identity.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part; neither do entries beyond 2**52 / 64 and
    vectors of another length than the commonest. A component without variance is null in ``whitened`` and left out of
    ``identity_error``. Equal rows give equal rows. No usable row gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    fitted = fit(vectors, components, id_col, vector_col)
    if fitted is None:
        return spark.createDataFrame([], f"vec_id {id_type}, n bigint, deviation bigint, whitened array<double>, "
                                         "explained array<double>, identity_error double")
    live = fitted.values > 0
    covariance = _scatter(fitted.projected) / fitted.n
    off = np.abs(covariance - np.eye(len(live)))[np.ix_(live, live)]
    projected = callMLlibFunc("getIndexedRows", fitted.projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    values = projected.select("index", vector_to_array(F.col("vector")).alias("w"))
    whitened = F.zip_with("w", F.lit(live.tolist()), lambda w, on: F.when(on, w))
    exact = F.aggregate("d", F.lit(0).cast("long"), lambda s, v: F.try_add(s, F.try_multiply(v, v)))
    return fitted.rows.join(values, "index").select(
        "vec_id", F.lit(fitted.n).cast("long").alias("n"), exact.alias("deviation"), whitened.alias("whitened"),
        F.lit(fitted.explained.tolist()).alias("explained"), F.lit(float(off.max()) if off.size else 0.0).alias("identity_error"))
