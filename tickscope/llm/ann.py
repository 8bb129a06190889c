"""Approximate nearest neighbours: inverted lists and an adaptive scan of the dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickscope.llm.common import map_cells, runs, stored
from tickscope.llm.vectors import matrix, unit, usable

SAMPLE = 16_000  # vectors at most on which lists are fitted
PROBES = 400  # vectors of the sample whose neighbours in it decide how many lists are probed
MOST_LISTS = 1024
BLOCK, QUERIES = 2048, 512  # vectors and queries of one cell
COLUMNS = 16  # dimensions of a column block
SEED = 256  # vectors of a cell that are computed in full first
EPSILON = 2.1  # of the hypothesis test: larger is safer and slower
TIES = 1e-5  # float32 distances closer than this to the last place are computed in double precision


@dataclass
class Index:
    """Fitted on the sample: centres of the lists, a random rotation, and the number of lists to probe."""

    dims: int
    centres: np.ndarray
    rotation: np.ndarray
    probes: int

    def rotate(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return ((x / norm[:, None]) @ self.rotation).astype(np.float32)


def fit_index(sample: np.ndarray, n_rows: int, k: int, recall: float) -> Index:
    """Spherical k-means on the sample; enough probes for ``recall`` of the sample's own neighbours."""
    rng = np.random.default_rng(7)
    x, norm = unit(sample)
    u = x / norm[:, None]
    n_lists = int(min(MOST_LISTS, max(1, len(u) // 16), max(8, np.sqrt(n_rows) / 2)))
    centres = u[rng.choice(len(u), n_lists, replace=False)]
    for _ in range(8):
        of = (u @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, u)
        length = np.sqrt((sums ** 2).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    of = (u @ centres.T).argmax(axis=1)
    asked = rng.choice(len(u), min(PROBES, len(u)), replace=False)
    scores = u[asked] @ u.T
    scores[np.arange(len(asked)), asked] = -2
    near = np.argsort(-scores, axis=1)[:, :min(k, len(u) - 1)]
    order = np.argsort(-(u[asked] @ centres.T), axis=1)
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(place, of[near], axis=1).ravel() + 1 if near.size else np.array([n_lists])
    probes = int(np.quantile(needed, recall, method="higher"))
    rotation = np.linalg.qr(rng.standard_normal((u.shape[1], u.shape[1])))[0]
    return Index(u.shape[1], centres, rotation, probes)


def adaptive_scan(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that may be among the k nearest, from rotated unit vectors in column blocks.

    The first vectors give each query a distance to beat. For the others partial squared distances grow
    by one column block at a time; after s of d dimensions, a pair is abandoned when its distance scaled by d/s is
    above that distance by more than the factor (1 + EPSILON / sqrt(s))², which random rotation makes unlikely for
    a pair that belongs in the answer.
    """
    d, m = q.shape[1], len(x)
    seed = min(m, max(SEED, k + 1))
    known = 2 - 2 * (q @ x[:seed].T)
    place = min(k, seed - 1)
    beat = np.partition(known, place, axis=1)[:, place] if m > seed else np.full(len(q), np.inf, np.float32)
    rest, dense = x[seed:], np.zeros((len(q), m - seed), np.float32)
    i = j = part = None
    for start in range(0, d, COLUMNS):
        cols, upto = slice(start, start + COLUMNS), min(d, start + COLUMNS)
        limit = beat * (upto / d) * ((1 + EPSILON / np.sqrt(upto)) ** 2 if upto < d else 1) + TIES
        if i is None:
            a, b = q[:, cols], rest[:, cols]
            dense += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
            alive = dense <= limit[:, None]
            if upto == d or alive.mean() < 0.1:
                i, j = np.nonzero(alive)
                part = dense[i, j]
        else:
            part = part + ((q[i, cols] - rest[j, cols]) ** 2).sum(axis=1)
            alive = part <= limit[i]
            i, j, part = i[alive], j[alive], part[alive]
    # the k nearest of what is left, with all that lie as near as the last of them
    rows = np.concatenate([np.repeat(np.arange(len(q)), seed), i])
    cols = np.concatenate([np.tile(np.arange(seed), len(q)), j + seed])
    dist = np.concatenate([known.ravel(), part])
    order = np.lexsort((dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    begin = np.searchsorted(rows, np.arange(len(q)))
    end = np.searchsorted(rows, np.arange(len(q)), side="right")
    last = dist[np.minimum(begin + k, end - 1)]  # one more than k: the query's own row may be among them
    kept = dist <= last[rows] + TIES
    return rows[kept], cols[kept]


TILE_TYPE = "list string, tile string, ids binary, n int, dims int, vectors binary"
TILE_FIELDS = pa.schema([("list", pa.string()), ("tile", pa.string()), ("ids", pa.binary()), ("n", pa.int32()),
                         ("dims", pa.int32()), ("vectors", pa.binary())])


def _assign(index: Index | None, probes: int, sizes: np.ndarray | None, k: int):
    """Rows with the keys of the lists they go to; vectors of another length share one list per length.

    The lists are the nearest ``probes``. With ``sizes``, the vectors in each list, a row also goes to as many further
    ones as it takes to cover ``k`` vectors besides those that share its id (``same`` of them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = batch.column("same").to_numpy()
            batch = batch.select(["id", "embedding"])
            lengths = batch.column("embedding").value_lengths().to_numpy()
            for dims in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == dims))
                if index is None or dims != index.dims:
                    take, keys = np.arange(rows.num_rows), [f"{dims}:-"] * rows.num_rows
                else:
                    x, norm = unit(matrix(rows.column("embedding")))
                    near = np.argsort(-((x / norm[:, None]) @ index.centres.T), axis=1, kind="stable")
                    asked = np.full(rows.num_rows, min(probes, near.shape[1]))
                    if sizes is not None:
                        short = np.cumsum(sizes[near], axis=1) < (k + same[lengths == dims])[:, None]
                        asked = np.maximum(asked, np.minimum(short.sum(axis=1) + 1, near.shape[1]))
                    take = np.repeat(np.arange(rows.num_rows), asked)
                    keys = [f"{dims}:{c}" for c in near[np.arange(near.shape[1]) < asked[:, None]].tolist()]
                    for s in range(0, len(take), 8192):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[s:s + 8192], pa.string()), *rows.take(pa.array(take[s:s + 8192])).columns],
                            ["list", "id", "embedding"])
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *rows.columns], ["list", "id", "embedding"])

    return run


def _pack(kind: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, rows in enumerate(runs(batches, "list", limit)):
            x = matrix(rows.column("embedding"))
            yield pa.RecordBatch.from_pylist([{
                "list": rows.column("list")[0].as_py(), "tile": f"{kind}{part}-{number}", "n": len(x), "dims": x.shape[1],
                "ids": rows.column("id").to_numpy().astype(np.int64).tobytes(), "vectors": x.tobytes()}], schema=TILE_FIELDS)

    return run


def _tiles(rows: DataFrame, index: Index | None, probes: int, kind: str, limit: int, sizes: np.ndarray | None = None,
           k: int = 0) -> DataFrame:
    id_type = rows.schema["id"].dataType.simpleString()
    vector_type = rows.schema["embedding"].dataType.simpleString()
    listed = rows.mapInArrow(_assign(index, probes, sizes, k), f"list string, id {id_type}, embedding {vector_type}")
    # stored first: range partitioning looks at its input twice
    listed = stored(listed)
    return stored(listed.repartitionByRange("list", "id").sortWithinPartitions("list", "id").mapInArrow(
        _pack(kind, limit), TILE_TYPE))


def _read(row: dict, index: Index | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dims"])
    scaled, norm = unit(x)
    rotated = (scaled / norm[:, None]).astype(np.float32)
    if index is not None and row["dims"] == index.dims:
        rotated = index.rotate(scaled, norm)
    return np.frombuffer(row["ids"], np.int64), scaled, norm, rotated


def _search(index: Index | None, k: int):
    def work(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {r["tile"][0]: r for r in cell.to_pylist()}
        q_ids, q, q_norm, q_rot = _read(rows["q"], index)
        ids, x, norm, x_rot = _read(rows["v"], index)
        # rows that share the query's id are no candidates, so they must not take the places of others
        same = np.unique(ids[np.isin(ids, q_ids)], return_counts=True)[1].max(initial=1)
        i, j = adaptive_scan(q_rot, x_rot, k + int(same) - 1)
        step = max(1, (1 << 22) // x.shape[1])
        score = np.concatenate([(q[i[s:s + step]] * x[j[s:s + step]]).sum(axis=1) / (q_norm[i[s:s + step]] * norm[j[s:s + step]])
                                for s in range(0, len(i), step)])
        other = q_ids[i] != ids[j]
        i, j, score = i[other], j[other], score[other]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < k
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[best]]), pa.array(ids[j[best]]), pa.array(score[best])],
                                         ["query_id", "vec_id", "score"])

    return work


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.97, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query by cosine: ``query_id, rank, vec_id, score``.

    ``base`` and ``queries`` hold an id and a vector. Lists and a rotation are fitted on at most ``SAMPLE``
    vectors of ``base`` (those with the smallest hashes); the number of probed lists is the least that finds
    ``recall`` of the sample's own neighbours; a query whose probed lists hold fewer than ``k`` other vectors probes as
    many further ones as it takes, so it gets ``k`` rows unless the table has fewer candidates. Every vector is indexed in its nearest list. Lists are cut into blocks and
    so are the queries that probe them, so a list with a third of all vectors is many cells. In a cell,
    ``adaptive_scan`` gives up most pairs early, what is left is scored in double precision on the original
    vectors. At most ``k`` rows per query and cell are merged.

    A query's own row, and any that shares its id, is no candidate. Ties go to the smaller id. Vectors that are null, zero
    or hold null or non-finite components, and null ids, take no part; vectors of another length than the
    sample's are searched in full among their own. An empty base or no queries give no rows.
    """
    vectors = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding")).where(
        usable(F.col("embedding")) & F.col("id").isNotNull())
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding")).where(
        usable(F.col("embedding")) & F.col("id").isNotNull())
    n_rows = vectors.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, n_rows))
    chosen = F.xxhash64("id", "embedding")
    sample = [np.array(r.embedding, np.float64) for r in vectors.where(
        F.pmod(chosen, F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(chosen, "id").limit(SAMPLE).select("embedding").collect()]
    index = None
    if sample:
        lengths, counts = np.unique([len(s) for s in sample], return_counts=True)
        dims = lengths[counts.argmax()]
        index = fit_index(np.stack([s for s in sample if len(s) == dims]), n_rows, k, recall)
    held = _tiles(vectors.withColumn("same", F.lit(1).cast("long")), index, 1, "v", BLOCK)
    sizes = None
    if index is not None:
        sizes = np.zeros(len(index.centres), np.int64)
        for r in held.where(F.col("list").isin([f"{index.dims}:{c}" for c in range(len(sizes))])).groupBy("list").agg(
                F.sum("n").alias("n")).collect():
            sizes[int(r["list"].split(":")[1])] = r.n
    # ids that several vectors share are few or none
    shared = vectors.groupBy("id").agg(F.count("*").alias("same")).where("same > 1")
    asked = asked.join(shared, "id", "left").select("id", "embedding", F.coalesce("same", F.lit(1)).cast("long").alias("same"))
    tiles = held.unionByName(_tiles(asked, index, index.probes if index else 1, "q", QUERIES, sizes, k))
    blocks = tiles.where("tile like 'v%'").select("list", F.col("tile").alias("block"))
    probing = tiles.where("tile like 'q%'").select("list", F.col("tile").alias("probe"))
    pairs = blocks.join(probing, "list").withColumn("cell", F.concat_ws("/", "block", "probe"))
    cells = pairs.select("cell", F.explode(F.array("block", "probe")).alias("tile")).join(tiles.drop("list"), "tile")
    found = map_cells(cells, "cell", lambda: _search(index, k), "query_id bigint, vec_id bigint, score double")
    first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
