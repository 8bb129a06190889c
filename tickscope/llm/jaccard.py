"""N-gram Jaccard join: MinHash values compared in steps with Bayesian pruning, the rest verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import bounded_batches, local_roots, map_cells, stored
from tickscope.llm.components import components
from tickscope.llm.shingles import N_HASHES, set_digest, shingle_set, signature

ROWS = 5  # MinHash values of a band: 32 bands miss a pair of similarity 0.8 with probability 3e-6
BANDS = N_HASHES // ROWS
STEP = 32  # MinHash values compared before the posterior is looked at again
TOLERANCE = 1e-7  # a pair is dropped when it reaches the threshold with less probability
BUCKET = 1024  # classes of a bucket that are compared in one cell; larger buckets become several cells
BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # the same for verification, where whole texts meet


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """Per multiple of ``STEP`` hashes: the fewest matches with which a pair stays.

    With a uniform prior, m matches among n hashes leave the similarity a Beta(m + 1, n - m + 1)
    posterior; it reaches t with the probability that n + 1 trials at t have at most m successes.
    """
    fewest = []
    for n in range(STEP, N_HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        fewest.append(m)
    return tuple(fewest)


def likely_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signature rows (of one matrix if ``b`` is None) that no step drops."""
    other = a if b is None else b
    fewest = least_matches(threshold)
    same = np.zeros((len(a), len(other)), np.uint8)
    for k in range(STEP):
        same += a[:, k][:, None] == other[:, k]
    alive = same >= fewest[0]
    if b is None:
        alive &= np.tri(len(a), dtype=bool, k=-1).T
    i, j = np.nonzero(alive)
    matches = same[i, j].astype(np.int32)
    for step, least in enumerate(fewest[1:], 1):
        cols = slice(step * STEP, (step + 1) * STEP)
        for s in range(0, len(i), 1 << 16):
            part = slice(s, s + (1 << 16))
            matches[part] += (a[i[part], cols] == other[j[part], cols]).sum(axis=1, dtype=np.int32)
        kept = matches >= least
        i, j, matches = i[kept], j[kept], matches[kept]
    return i, j


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (sets[i], sets[j]); the sets are sorted and distinct."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())],
                        np.int64)
    # Many pairs: products of incidence matrices, over the shingles that several sets hold.
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts[codes] > 1
    number = np.cumsum(counts > 1) - 1
    rows, codes = rows[shared], number[codes[shared]]
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(codes[-1]) + 1 if len(codes) else 0, 4096):
        at = slice(*np.searchsorted(codes, [start, start + 4096]))
        block = np.zeros((len(sets), 4096), np.float32)
        block[rows[at], codes[at] - start] = 1
        total += block @ block.T
    return total[i, j].astype(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, sizes, sigs = [], [], []
        for text in batch.column("text").to_pylist():
            shingles = shingle_set(text or "")
            some = len(shingles) > 0
            cls.append(set_digest(shingles) if some else None)
            sizes.append(len(shingles))
            sigs.append(signature(shingles).tobytes() if some else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(cls, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())],
            ["doc_id", "h", "cls", "size", "sig"])


def _cells(members: DataFrame, group: str, blocks, key) -> DataFrame:
    """Members of each group in the cells of its blocks; two different blocks meet in a cell with sides 0 and 1."""
    dealt = members.withColumn("nb", blocks.cast("int")).withColumn("block", F.pmod(key, F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return dealt.withColumn("other", other).withColumn("cell", F.concat_ws("/", F.col(group).cast("string"), low, high)).withColumn(
        "side", F.when(F.col("block") > F.col("other"), 1).otherwise(0)).withColumn(
        "cross", F.col("block") != F.col("other")).drop("nb", "block", "other")


def _sides(cell: pa.Table) -> tuple[dict, int]:
    """Columns with side 0 first, and the size of side 0 in a cell of two blocks (0: one block)."""
    cell = cell.sort_by("side")
    cross = cell.column("cross")[0].as_py()
    first = int((cell.column("side").to_numpy() == 0).sum()) if cross else 0
    return {c: cell.column(c) for c in cell.column_names}, first


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), N_HASHES)


def _pairs(sig: np.ndarray, cross: bool, first: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    if not cross:
        return likely_pairs(sig, None, threshold)
    i, j = likely_pairs(sig[:first], sig[first:], threshold)
    return i, j + first


def _bucket_worker(threshold: float):
    def work(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        columns, first = _sides(cell)
        cls = columns["cls"].to_pylist()
        i, j = _pairs(_matrix(columns["sig"]), columns["cross"][0].as_py(), first, threshold)
        root = local_roots(len(cls), i, j)
        moved = np.flatnonzero(root != np.arange(len(cls))).tolist()
        if moved:
            yield pa.RecordBatch.from_arrays([pa.array([cls[m] for m in moved], pa.binary()),
                                              pa.array([cls[root[m]] for m in moved], pa.binary())], ["a", "b"])

    return work


def _verifier(threshold: float):
    top, bottom = round(threshold * 1_000_000), 1_000_000

    def work(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        columns, first = _sides(cell)
        cls, n = columns["cls"].to_pylist(), columns["n"].to_numpy()
        i, j = _pairs(_matrix(columns["sig"]), columns["cross"][0].as_py(), first, threshold)
        size = columns["size"].to_numpy().astype(np.int64)
        fits = np.minimum(size[i], size[j]) * bottom >= top * np.maximum(size[i], size[j])
        i, j = i[fits], j[fits]
        if not len(i):
            return
        needed = np.unique(np.concatenate([i, j]))
        texts = columns["text"]
        sets = [shingle_set(texts[k].as_py() or "") for k in needed.tolist()]
        place = np.zeros(len(cls), np.int64)
        place[needed] = np.arange(len(needed))
        common = intersections(sets, place[i], place[j])
        linked = common * bottom >= top * (size[i] + size[j] - common)
        i, j = i[linked], j[linked]
        links = np.bincount(i, n[j], len(cls)) + np.bincount(j, n[i], len(cls))
        root = local_roots(len(cls), i, j)
        hit = np.unique(np.concatenate([i, j])).tolist()
        if hit:
            yield pa.RecordBatch.from_arrays(
                [pa.array([cls[k] for k in hit], pa.binary()), pa.array(links[hit].astype(np.int64)),
                 pa.array([cls[root[k]] for k in hit], pa.binary())], ["cls", "links", "root"])

    return work


def jaccard_links(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose sets of five-word shingles have a Jaccard similarity of at least ``threshold``.

    Returns one row per input row: ``doc_id, n_links`` (other documents linked directly, copies
    included), ``component_id`` (smallest id reachable by links), ``kept`` (one row of each component) and
    ``h``, the hash of the text. Words are runs of characters other than ASCII white space.

    1. Texts with equal shingle sets form a class with a count; copies go no further.
    2. Classes that agree on a band of MinHash values share a bucket. Buckets with the same members as
       another are dropped; large ones are cut into blocks that meet pairwise in cells.
    3. In a cell the MinHash values of pairs are compared ``STEP`` at a time, and a pair goes when the
       posterior probability of reaching the threshold falls below ``TOLERANCE``. The cell gives a spanning
       forest of the pairs that stay, never the pairs.
    4. The components of these forests hold every pair that stayed. Their texts meet once, in blocks,
       where pairs are pruned again and the rest are verified on whole shingle sets. Cells give counts and roots.

    A pair at the threshold is missed with a probability of about 3e-6 (no common band), more similar
    ones with less; no pair below the threshold is linked. Buckets and components have no cap.

    A text of one to four words is one shingle; null, empty and blank texts link with nothing and are kept. Repeated rows
    link like any copies and only one is kept. Null ids rank last. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    signed = stored(rows.mapInArrow(_signatures, f"doc_id {id_type}, h bigint, cls binary, size int, sig binary").withColumn(
        "row", F.monotonically_increasing_id()))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "h")
    classes = stored(signed.where("cls is not null").groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"), F.min(rank).alias("least"), F.any_value("size").alias("size"), F.any_value("sig").alias("sig")))

    near = components(stored(_likely_edges(classes, threshold)))
    sizes = near.join(classes.select(F.col("cls").alias("node"), "size"), "node").groupBy("component").agg(
        F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    placed = near.join(sizes, "component").join(classes.withColumnRenamed("cls", "node"), "node")
    reps = placed.select("component", F.col("node").alias("cls"), "members", "shingles", "n", "size", "sig",
                         F.col("least.h").alias("of_h"), F.col("least.doc_id").alias("of_id"))
    texts = rows.join(reps, (F.col("h") == F.col("of_h")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).drop(
        "of_h", "of_id", "doc_id", "h").dropDuplicates(["cls"])
    cells = _cells(texts, "component", blocks, F.xxhash64("cls")).select("cell", "side", "cross", "cls", "n", "size", "sig", "text")
    hits = stored(map_cells(cells.withColumn("cell", F.md5("cell")), "cell", lambda: _verifier(threshold),
                            "cls binary, links bigint, root binary"))

    linked = hits.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(hits.select("cls", "root"), "cls", "root").withColumnRenamed("node", "cls")
    whole = classes.select("cls", "n", "least").join(linked, "cls", "left").join(groups, "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    first = whole.groupBy("component").agg(F.min("least").alias("first"))
    result = whole.join(first, "component").select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "first")
    joined = signed.drop("sig").join(result, "cls", "left")
    alone = F.col("cls").isNull()
    return joined.select(
        "doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"), "h")


def _likely_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """Steps 2 and 3: forests of the likely pairs of each bucket."""
    width = 2 * ROWS
    bands = F.array(*(F.xxhash64(F.lit(k), F.substring("sig", k * width + 1, width)) for k in range(BANDS)))
    entries = classes.select("cls", F.explode(bands).alias("band"))
    buckets = entries.groupBy("band").agg(
        F.count(F.lit(1)).alias("in_bucket"), F.bit_xor(F.xxhash64("cls")).alias("print"), F.min("cls").alias("least")
    ).where("in_bucket > 1").groupBy("in_bucket", "print", "least").agg(F.min("band").alias("band"))
    members = entries.join(buckets.select("band", "in_bucket"), "band")
    cells = _cells(members, "band", F.ceil(F.col("in_bucket") / BUCKET), F.xxhash64("cls"))
    signed = cells.join(classes.select("cls", "sig"), "cls").select("cell", "side", "cross", "cls", "sig")
    return map_cells(signed, "cell", lambda: _bucket_worker(threshold), "a binary, b binary")


def without_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component of near-duplicates, with their own columns.

    Rows with the same id and text count as one document.
    """
    found = jaccard_links(docs, threshold, id_col, text_col)
    gone = stored(found.groupBy("doc_id", "h").agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("copies"))).where(
        "not stays or copies > 1").select("doc_id", "h", "stays")
    # The columns of a document travel as one, so none of them can clash with the keys.
    text = F.col(f"`{text_col}`")
    blank = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]")) == 0, F.lit(True))
    keyed = docs.select(F.col(f"`{id_col}`").alias("of_id"), F.xxhash64(text).alias("of"), blank.alias("blank"),
                        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    same = (F.col("of") == F.col("h")) & F.col("of_id").eqNullSafe(F.col("doc_id"))
    single = keyed.join(gone, same, "left_anti")
    repeated = keyed.join(gone.where("stays"), same, "left_semi")
    once = repeated.where(~F.col("blank")).dropDuplicates(["of_id", "of"])
    return single.unionByName(once).unionByName(repeated.where("blank")).select("doc.*")
