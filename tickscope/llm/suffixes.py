"""Exact substring dedup: byte strings of a given length that also start earlier are removed.

The corpus is kept as chunk files of some megabytes in the shared folder, and tasks get the paths of
chunks with what other chunks have told about them. Four rounds of names, each one exchange:

1. whole texts: a copy of an earlier text is covered entirely and takes no further part;
2. samples: of each string of ``length`` bytes the least hashed k-gram is sampled. Equal strings
   have equal samples at equal offsets, so the samples are a difference cover that follows the
   content. A sampled k-gram that occurs once rules out every string around it;
3. strings: those whose samples all occur again are named by a 64-bit hash of their bytes. Of equal
   ones in a chunk only the first is sent on, so a string in a third of all documents costs one name per chunk;
4. a bit per name tells its chunk whether it starts earlier elsewhere, and each chunk cuts its texts.

Suffixes are not sorted over the whole corpus: see the README for the sizes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import bounded_batches, map_cells, stored
from tickscope.llm.token_files import _open_folder
from tickscope.session import ensure_checkpoint_dir

LENGTH = 100
CHUNK = 2 << 20  # bytes of text in a chunk, if no text is longer
BLOCK = 1 << 14  # places that are hashed or compared at a time, so that all steps stay in the processor's cache
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64)
LAST = np.iinfo(np.int64).max  # the rank of a null id


def _mix(x: np.ndarray) -> None:
    """Mixes the bits of each number, in place."""
    shifted = x >> np.uint64(30)
    for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
        x ^= shifted
        x *= np.uint64(factor)
        np.right_shift(x, np.uint64(shift), out=shifted)
    x ^= shifted


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, factor, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


@lru_cache(maxsize=4)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(_INVERSE, n)


class Hashes:
    """Hashes of strings of a length in ``data``, from prefix sums of blocks; a hash does not depend on the place."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def of(self, length: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Of all strings, or of those at the ascending ``starts``."""
        n = max(0, len(self.data) - length + 1)
        up, down = _tables(BLOCK + length)
        out = np.empty(n if starts is None else len(starts), np.uint64)
        edges = None if starts is None else np.searchsorted(starts, np.arange(0, n + BLOCK, BLOCK)).tolist()
        for number, b in enumerate(range(0, n, BLOCK)):
            e = min(n, b + BLOCK)
            own = out[b:e] if edges is None else out[edges[number]:edges[number + 1]]
            if not len(own):
                continue
            values = _BYTES[self.data[b:e + length - 1]]
            values *= up[:len(values)]
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            if edges is None:
                np.subtract(sums[length:], sums[:-length], out=own)
                own *= down[:e - b]
            else:
                at = starts[edges[number]:edges[number + 1]] - b
                np.subtract(sums[at + length], sums[at], out=own)
                own *= down[at]
            _mix(own)
        return out


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours, by doubling."""
    n = max(0, len(values) - width + 1)
    out = np.empty(n, values.dtype)
    for b in range(0, n, BLOCK):
        e = min(n, b + BLOCK)
        part, have = values[b:e + width - 1], 1
        while have < width:
            step = min(have, width - have)
            part = pick(part[:-step], part[step:])
            have += step
        out[b:e] = part
    return out


def _around(places: np.ndarray, window: int) -> np.ndarray:
    """All starts, ascending, whose next ``window`` places hold one of the ascending ``places``."""
    if not len(places):
        return np.zeros(0, np.int64)
    low, high = np.maximum(0, places - window + 1), places + 1
    first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    low, high = low[first], high[np.append(first[1:] - 1, len(high) - 1)]
    sizes = high - low
    return np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Chunk:
    """Texts one behind the other, with the places at which strings of ``length`` bytes may start."""

    def __init__(self, data: bytes, sizes: np.ndarray, skipped: np.ndarray, length: int):
        self.data, self.length = np.frombuffer(data, np.uint8), length
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.hashes = Hashes(self.data)
        self.valid = np.zeros(max(0, len(self.data) - length + 1), bool)
        for b, e in zip(self.begins[~skipped].tolist(), self.ends[~skipped].tolist()):
            self.valid[b:max(b, e - length + 1)] = True
        self.k = max(1, length // 3)
        self.window = length - self.k + 1

    @cached_property
    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the sampled k-grams."""
        if not self.valid.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = self.hashes.of(self.k)
        self.order = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        pad = np.zeros(self.window - 1, np.uint32)
        padded = np.concatenate([pad, _sliding(self.order, self.window, np.minimum), pad])
        self.least = padded[len(pad):len(padded) - len(pad)]
        self.least *= self.valid
        places = np.flatnonzero(_sliding(padded, self.window, np.maximum) == self.order)
        return places, grams[places]

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and names of the strings that hold no sampled k-gram that occurs once."""
        places, grams = self.samples
        again = np.isin(grams, repeated)
        starts = _around(places[again], self.window)
        starts = starts[starts < len(self.valid)]
        starts = starts[self.valid[starts]]
        # a string that also holds a single sample is no repeat if that sample is its least k-gram
        once = places[~again]
        if len(once) and len(starts):
            single = np.full(len(self.order), np.iinfo(np.uint32).max, np.uint32)
            single[once] = self.order[once]
            following = np.append(once, len(self.data) + self.window)[np.searchsorted(once, starts)]
            beaten = (following < starts + self.window) & (
                _sliding(single, self.window, np.minimum)[starts] == self.least[starts])
            starts = starts[~beaten]
        return starts, self.hashes.of(self.length, starts)


def _split(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of the hashes, positions ascending."""
    of = (hashes % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # small ones sort by radix
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(of[part[0]]), part


def _write_chunks(folder: str, chunk: int):
    fields = pa.schema([("doc_id", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, path = _open_folder(folder)
        store.create_dir(path, recursive=True)
        held, n_held, number = [], 0, 0

        def flush():
            nonlocal held, n_held, number
            # texts in the order of their ids, so that places in a chunk are in the order of the corpus
            held.sort(key=lambda r: LAST if r[0] is None else r[0])
            name = f"{path}/chunk-{part:06d}-{number:06d}-{uuid.uuid4().hex}"
            texts = [t for _, t in held]
            with store.open_output_stream(name) as sink, pa.CompressedOutputStream(sink, "zstd") as out:
                out.write(b"".join(texts))
            row = {"chunk": part * 1_000_000 + number, "path": name, "ids": [i for i, _ in held], "sizes": [len(t) for t in texts],
                   "digests": [hashlib.blake2b(t, digest_size=16).digest() for t in texts]}
            held, n_held, number = [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("chunk", pa.int64()), ("path", pa.string()), ("ids", pa.list_(fields.field("doc_id").type)),
                ("sizes", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary()))]))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.append((doc_id, (text or "").encode()))
                n_held += len(held[-1][1])
                if n_held >= chunk or len(held) >= 20_000:
                    yield flush()
        if held:
            yield flush()

    return run


def _load(row: dict, folder: str, length: int) -> Chunk:
    store, _ = _open_folder(folder)
    with store.open_input_stream(row["path"]) as source, pa.CompressedInputStream(source, "zstd") as stream:
        data = stream.read()
    skipped = np.zeros(len(row["sizes"]), bool)
    skipped[row["copies"] or []] = True
    return Chunk(data, np.array(row["sizes"], np.int64), skipped, length)


NAMES = "bucket bigint, chunk bigint, hashes binary, ids binary"
NAME_FIELDS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("ids", pa.binary())])


def _blobs(chunk: int, hashes: np.ndarray, ids: np.ndarray | None, buckets: int) -> Iterator[pa.RecordBatch]:
    parts = list(_split(hashes, buckets))
    for s in range(0, len(parts), 4096):
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in parts[s:s + 4096]], pa.int64()), pa.array([chunk] * len(parts[s:s + 4096]), pa.int64()),
             pa.array([hashes[p].tobytes() for _, p in parts[s:s + 4096]], pa.binary()),
             pa.array([b"" if ids is None else _packed(ids[p]) for _, p in parts[s:s + 4096]], pa.binary())], schema=NAME_FIELDS)


def _packed(ids: np.ndarray) -> bytes:
    """Ids as compressed differences; names come in the order of their texts, so most are 0 or small."""
    return pa.compress(np.diff(ids, prepend=np.int64(0)).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64))


ANSWER = "chunk bigint, bucket bigint, told binary"


def _answer(cell: pa.Table, sizes: list[int], told: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One bit per name, in the order in which its chunk sent it; blobs without a set bit need no answer."""
    bits = np.split(told, np.cumsum(sizes)[:-1])
    some = [k for k, b in enumerate(bits) if b.any()]
    if some:
        rows = cell.take(pa.array(some))
        yield pa.RecordBatch.from_arrays(
            [rows.column("chunk").combine_chunks(), rows.column("bucket").combine_chunks(),
             pa.array([np.packbits(bits[k]).tobytes() for k in some], pa.binary())], ["chunk", "bucket", "told"])


def _told_of(hashes: np.ndarray, buckets: int, answers: list[dict] | None) -> np.ndarray:
    """Which hashes have their bit set, from the answers to ``_blobs`` of the same hashes."""
    parts = dict(_split(hashes, buckets)) if answers else {}
    told = np.zeros(len(hashes), bool)
    for a in answers or ():
        own = parts[a["bucket"]]
        told[own] = np.unpackbits(np.frombuffer(a["told"], np.uint8), count=len(own)).astype(bool)
    return told


def _again():
    def work(cell: pa.Table):
        each = [np.frombuffer(b, np.uint64) for b in cell.column("hashes").to_pylist()]
        _, codes, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        yield from _answer(cell, [len(e) for e in each], counts[codes] > 1)

    return work


def _later():
    def work(cell: pa.Table):
        each = [np.frombuffer(b, np.uint64) for b in cell.column("hashes").to_pylist()]
        sizes, hashes = [len(e) for e in each], np.concatenate(each)
        ids = np.concatenate([_unpacked(b, n) for b, n in zip(cell.column("ids").to_pylist(), sizes)])
        order = np.lexsort((np.repeat(cell.column("chunk").to_numpy(), sizes), ids, hashes))
        later = np.zeros(len(hashes), bool)
        later[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
        yield from _answer(cell, sizes, later)

    return work


def remove_repeats(docs: DataFrame, length: int = LENGTH, chunk: int = CHUNK, folder: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every byte that is covered by a string of ``length`` bytes that also starts earlier.

    Returns one row per input row: ``doc_id, kept`` (the remaining bytes), ``n_bytes`` and ``spans``, the maximal removed
    runs (``start, end`` in bytes). Earlier is a smaller id (null last), or in the same text a smaller
    start; overlaps count, strings are judged on the input, and none crosses texts. Ids are integers.
    Rows with equal ids rank by their place in the input files.

    Strings are compared by 64-bit hashes, whole texts by 128-bit ones: among n strings, two different ones are
    taken for equal with a probability of n²/2^65. Every text counts whole; a text longer than a chunk is a chunk
    of its own and needs about 60 times its bytes of memory. Null and empty texts have no spans.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/chunks/{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    manifest = stored(rows.mapInArrow(_write_chunks(folder, chunk), "chunk bigint, path string, ids array<bigint>, "
                                      "sizes array<bigint>, digests array<binary>"))
    n_chunks = manifest.count()
    if not n_chunks:
        return spark.createDataFrame([], "doc_id bigint, kept binary, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>")
    # a chunk sends a row to each bucket, so there are no more buckets than keep a cell to some chunks' names
    buckets = min(1 << 20, max(64, min(2 * n_chunks, 256), n_chunks // 2))
    info = manifest.join(_copies(manifest, length), "chunk", "left")

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(min(n_chunks, 10_000), "chunk")

    def sampled(batches):
        for row in (r for b in batches for r in b.to_pylist()):
            yield from _blobs(row["chunk"], _sampled(_load(row, folder, length)), None, buckets)

    slim = info.select("chunk", "path", "sizes", "copies")
    repeated = _told(map_cells(spread(slim).mapInArrow(sampled, NAMES), "bucket", _again, ANSWER))

    def named(batches):
        for row in (r for b in batches for r in b.to_pylist()):
            loaded = _load(row, folder, length)
            starts, names = loaded.candidates(_repeated(loaded, buckets, row["told"]))
            names, _, first = _distinct(names)
            ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)
            owner = np.searchsorted(loaded.ends, starts[np.flatnonzero(first)], side="right")
            yield from _blobs(row["chunk"], names, ids[owner], buckets)

    told = stored(info.select("chunk", "path", "sizes", "copies", "ids").join(repeated, "chunk", "left"))
    later = _told(map_cells(spread(told).mapInArrow(named, NAMES), "bucket", _later, ANSWER))

    def cut(batches):
        for row in (r for b in batches for r in b.to_pylist()):
            yield from _cut(row, _load(row, folder, length), length, buckets)

    whole = told.join(later.withColumnRenamed("told", "later"), "chunk", "left")
    return spread(whole).mapInArrow(
        cut, "doc_id bigint, kept binary, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>")


def _told(blobs: DataFrame) -> DataFrame:
    """All answers to a chunk: no more bits than it has bytes."""
    return blobs.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "told")).alias("told"))


def _sampled(chunk: Chunk) -> np.ndarray:
    """Distinct sampled hashes, those that occur again in the chunk twice."""
    hashes, counts = np.unique(chunk.samples[1], return_counts=True)
    return np.concatenate([hashes, hashes[counts > 1]])


def _repeated(chunk: Chunk, buckets: int, answers: list[dict] | None) -> np.ndarray:
    """The sampled hashes that occur again anywhere."""
    hashes = _sampled(chunk)
    return hashes[_told_of(hashes, buckets, answers)]


def _copies(manifest: DataFrame, length: int) -> DataFrame:
    """Per chunk, the numbers of the texts that equal an earlier one and are long enough to go."""
    texts = manifest.select("chunk", F.posexplode(F.arrays_zip("ids", "sizes", "digests")).alias("number", "t")).select(
        "chunk", "number", F.struct(F.coalesce("t.ids", F.lit(LAST)).alias("id"), "chunk", "number").alias("rank"),
        F.col("t.digests").alias("digest"), F.col("t.sizes").alias("size")).where(F.col("size") >= length)
    first = texts.groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return texts.join(first, "digest").where("rank > first").groupBy("chunk").agg(F.collect_list("number").alias("copies"))


def _distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names in the order of their first places, the number of each name among them, and whether it is at its first place."""
    numbered = pa.array(names).dictionary_encode()  # numbers rise in the order of first places
    codes = numbered.indices.to_numpy()
    upto = np.maximum.accumulate(codes)
    return numbered.dictionary.to_numpy(), codes, np.diff(upto, prepend=-1) > 0


def _cut(row: dict, chunk: Chunk, length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    starts, names = chunk.candidates(_repeated(chunk, buckets, row["told"]))
    distinct, codes, first_here = _distinct(names)
    gone = starts[_told_of(distinct, buckets, row["later"])[codes] | ~first_here]
    edges = np.zeros(len(chunk.data) + 1, np.int32)
    edges[gone] += 1  # each start is there once
    edges[gone + length] -= 1
    removed = np.cumsum(edges[:-1], out=edges[:-1]) > 0
    for number in row["copies"] or []:
        removed[chunk.begins[number]:chunk.ends[number]] = True
    out = []
    for doc_id, b, e in zip(row["ids"], chunk.begins.tolist(), chunk.ends.tolist()):
        own = removed[b:e]
        if not own.any():
            out.append({"doc_id": doc_id, "kept": chunk.data[b:e].tobytes(), "n_bytes": e - b, "spans": []})
            continue
        turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        out.append({"doc_id": doc_id, "kept": chunk.data[b:e][~own].tobytes(), "n_bytes": e - b,
                    "spans": [{"start": s, "end": t} for s, t in zip(turns[::2].tolist(), turns[1::2].tolist())]})
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("spans", pa.list_(span))])
    for s in range(0, len(out), 256):
        yield pa.RecordBatch.from_pylist(out[s:s + 256], schema=schema)
