"""Embedding near-dedup with int8 tile products and rigorous quantisation error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import local_roots, map_cells, runs, stored
from tickscope.llm.components import components

TILE = 1024  # vectors of one tile
SLACK = 1e-9  # for the rounding of the bounds themselves
EXACT_DIMS = 1024  # sums of so many products of int8 values are exact in float32


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List values of one length as a double matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(whole), -1)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by a power of two (exactly) into the range of safe squares, and their norms."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x, np.sqrt((x * x).sum(axis=1))


def quantised(x: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of the unit vectors, their scales, the norms of the decoded vectors and of the errors."""
    u = x / norm[:, None]
    scale = np.abs(u).max(axis=1) / 127.0
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.sqrt((decoded ** 2).sum(axis=1)), np.sqrt(((u - decoded) ** 2).sum(axis=1)) + SLACK


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of all codes: float32 matrix products are exact for up to ``EXACT_DIMS`` dimensions."""
    total = None
    for start in range(0, a.shape[1], EXACT_DIMS):
        part = a[:, start:start + EXACT_DIMS].astype(np.float32) @ b[:, start:start + EXACT_DIMS].astype(np.float32).T
        total = part.astype(np.float64) if total is None else total + part
    return total


def cosines(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (a[i], b[j]) in double precision, a bounded number at a time."""
    step = max(1, (1 << 22) // a.shape[1])
    out = [(a[i[s:s + step]] * b[j[s:s + step]]).sum(axis=1) / (na[i[s:s + step]] * nb[j[s:s + step]])
           for s in range(0, len(i), step)]
    return np.concatenate(out) if out else np.zeros(0)


def tile_links(a: dict, b: dict, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of two tiles with a cosine of at least ``threshold``.

    For unit vectors x = x' + e and y = y' + f, with x', y' decoded from int8, the cosine differs from
    x'y' by at most |x'||f| + |e||y'| + |e||f|. Only pairs that may reach the threshold by this bound are
    computed in full.
    """
    near = code_products(a["codes"], b["codes"]) * a["scale"][:, None] * b["scale"]
    near += a["size"][:, None] * b["error"] + a["error"][:, None] * (b["size"] + b["error"])
    possible = near >= threshold - SLACK
    if same:
        possible &= np.tri(*possible.shape, -1, dtype=bool).T
    i, j = np.nonzero(possible)
    linked = cosines(a["x"], a["norm"], b["x"], b["norm"], i, j) >= threshold
    return i[linked], j[linked]


TILE_SCHEMA = ("space string, tile string, n int, dims int, cids binary, weights binary, vectors binary, "
               "middle array<double>, radius double")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for number, rows in enumerate(runs(batches, "space", TILE)):
        x, norm = unit(matrix(rows.column("embedding")))
        u = x / norm[:, None]
        middle = u.mean(axis=0)
        length = np.sqrt((middle ** 2).sum())
        middle = middle / length if length > 1e-12 else u[0]
        yield pa.RecordBatch.from_pylist([{
            "space": rows.column("space")[0].as_py(), "tile": f"{part}-{number}", "n": len(x), "dims": x.shape[1],
            "cids": rows.column("cid").to_numpy().astype(np.int64).tobytes(),
            "weights": rows.column("n").to_numpy().astype(np.int64).tobytes(), "vectors": x.tobytes(),
            "middle": middle.tolist(), "radius": float(np.arccos(np.clip((u @ middle).min(), -1, 1)))}],
            schema=pa.schema([("space", pa.string()), ("tile", pa.string()), ("n", pa.int32()), ("dims", pa.int32()),
                              ("cids", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()),
                              ("middle", pa.list_(pa.float64())), ("radius", pa.float64())]))


def _read_tile(row: dict) -> dict:
    x = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dims"])
    norm = np.sqrt((x * x).sum(axis=1))
    codes, scale, size, error = quantised(x, norm)
    return {"x": x, "norm": norm, "codes": codes, "scale": scale, "size": size, "error": error,
            "cid": np.frombuffer(row["cids"], np.int64), "weight": np.frombuffer(row["weights"], np.int64)}


def _cell_worker(threshold: float):
    def work(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        a, *rest = [_read_tile(r) for r in sorted(cell.to_pylist(), key=lambda r: r["tile"])]
        b = rest[0] if rest else a
        i, j = tile_links(a, b, threshold, same=not rest)
        if not len(i):
            return
        cid = np.concatenate([a["cid"], b["cid"]]) if rest else a["cid"]
        j_at = j + len(a["cid"]) if rest else j
        links = np.bincount(i, b["weight"][j], len(cid)) + np.bincount(j_at, a["weight"][i], len(cid))
        root = local_roots(len(cid), i, j_at)
        hit = np.unique(np.concatenate([i, j_at]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cid[hit]), pa.array(links[hit].astype(np.int64)), pa.array(cid[root[hit]])], ["cid", "links", "root"])

    return work


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """Near-duplicate vectors of one label: ``vec_id, n_links, component_id, kept``, one row per input row.

    Equal vectors of a label become one class with a weight. Classes are sorted into tiles of at most
    ``TILE`` vectors, which carry a centre and an angular radius; pairs of tiles that cannot hold a link
    by the triangle inequality are dropped, the others meet in a cell of their own, so that a label with a
    third of all rows is spread over many tasks. A cell gives back per class its links and its root in
    the cell, never pairs. Every pair of equal label whose cosine is at least ``threshold`` is found.

    Work grows with the square of a label's classes wherever tiles are not apart; the int8 products
    make that cheap, not linear.

    Vectors that are null, zero or hold null or non-finite components, and those without a label, link
    with nothing and are kept. Vectors of different lengths do not link. Rows that repeat an id and a
    vector link with each other and are kept together. A null id is never a component's id unless nothing else is.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    fit = usable(F.col("embedding")) & F.col("label").isNotNull()
    space = F.concat_ws(":", F.size("embedding"), F.col("label").cast("string"))
    classes = stored(rows.where(fit).groupBy(space.alias("space"), "embedding").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")
    ).withColumn("cid", F.monotonically_increasing_id()))
    signs = F.concat(*(F.when(F.get("embedding", F.lit(k)) > 0, F.lit("1")).otherwise(F.lit("0")) for k in range(8)))
    tiles = stored(classes.withColumn("signs", signs).repartitionByRange("space", "signs", "cid").sortWithinPartitions(
        "space", "signs", "cid").select("space", "cid", "n", "embedding").mapInArrow(_tiles, TILE_SCHEMA))
    hits = stored(map_cells(_cells(tiles, threshold), "cell", lambda: _cell_worker(threshold),
                            "cid bigint, links bigint, root bigint"))
    linked = hits.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(hits.select("cid", "root"), "cid", "root").withColumnRenamed("node", "cid")
    placed = classes.join(linked, "cid", "left").join(groups, "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    first = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    result = placed.join(first, "component").select(
        "space", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    joined = rows.withColumn("space", F.when(fit, space)).join(result, ["space", "embedding"], "left")
    component_id = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))


def _cells(tiles: DataFrame, threshold: float) -> DataFrame:
    """Tile pairs that may hold a link, each with its one or two tiles."""
    meta = tiles.select("space", "tile", "middle", "radius")
    other = meta.select("space", F.col("tile").alias("tile_b"), F.col("middle").alias("middle_b"), F.col("radius").alias("radius_b"))
    dot = F.aggregate(F.zip_with("middle", "middle_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("radius") - F.col("radius_b")
    pairs = meta.join(other, "space").where((F.col("tile") <= F.col("tile_b")) & (apart <= float(np.arccos(threshold)) + 1e-6))
    sides = pairs.select(F.concat_ws("/", "tile", "tile_b").alias("cell"),
                         F.explode(F.array_distinct(F.array("tile", "tile_b"))).alias("tile"))
    return sides.join(tiles.drop("middle", "radius", "space"), "tile")
