"""Token files: Arrow IPC files of fixed-size-list batches, and reading documents back from them."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickscope.llm.common import bounded_batches, stored
from tickscope.llm.pieces import text_encoder
from tickscope.session import ensure_checkpoint_dir

SEQUENCE = 1024  # ids of one sequence
BATCH = 256  # sequences of one record batch; all batches of a file but the last have so many
GROUP = 8 << 20  # bytes of text that are encoded together, if no text is longer
MANIFEST = "part int, tokens_path string, index_path string, n_docs bigint, n_tokens bigint, sequence int, batch int"


def _open_folder(uri: str):
    """(file system, path in it) of a folder in any store that Arrow knows (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Neighbouring batches as tables of about ``size`` bytes."""
    held, n_held = [], 0
    for batch in batches:
        held.append(batch)
        n_held += batch.nbytes
        if n_held >= size:
            yield pa.Table.from_batches(held)
            held, n_held = [], 0
    if held:
        yield pa.Table.from_batches(held)


class SequenceWriter:
    """Collects ids and writes them as equal-length sequences with masks; the last one is padded."""

    def __init__(self, sink, dtype: np.dtype, sequence: int, batch: int):
        self.dtype, self.sequence, self.room = dtype, sequence, sequence * batch
        ids = pa.list_(pa.from_numpy_dtype(dtype), sequence)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), sequence))],
                                metadata={"sequence": str(sequence), "batch": str(batch)})
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes | pa.Buffer] = []
        self.n_held = self.n_tokens = 0

    def add(self, ids: bytes | pa.Buffer) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // self.dtype.itemsize
        if self.n_held >= self.room:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            whole = len(flat) // self.room * self.room
            for start in range(0, whole, self.room):
                self._write(flat[start:start + self.room])
            self.held, self.n_held = [flat[whole:].tobytes()], len(flat) - whole

    def _write(self, flat: np.ndarray) -> None:
        self.n_tokens += len(flat)
        padded = -len(flat) % self.sequence
        values = np.concatenate([flat, np.zeros(padded, self.dtype)])
        mask = np.arange(len(values)) < len(flat)
        self.writer.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(values), self.sequence),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)], schema=self.schema))

    def close(self) -> int:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        if len(flat):
            self._write(flat)
        self.writer.close()
        return self.n_tokens


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None,
                      sequence: int = SEQUENCE, batch: int = BATCH, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Encodes whole texts in ascending id order and writes token files; returns the manifest.

    Documents are range-partitioned and sorted by (id, hash of the text): rows that share an id, null
    ids among them (first), are split over tasks like any others. Each task writes one file of ids: record batches
    of ``batch`` fixed-size lists of ``sequence`` ids, with a mask that is false on padding, and no
    compression, so that sequence ``s`` is at a computed place of a memory map. Beside it lies an index file
    (``doc_id``, ``start`` in this file, ``n_tokens``). Ids take two bytes if the vocabulary allows it.

    File names carry a random part and only the files of the attempt that succeeded are in the manifest,
    so lost executors and second attempts leave at most unused files. ``folder`` is one that all executors
    share, by default below ``spark.checkpoint.dir``. A null or empty text is the end id alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/tokens/{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("h"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, path = _open_folder(folder)
        store.create_dir(path, recursive=True)
        encoder, dtype = text_encoder(tokenizer_path, end_id)
        end, start, writer, index = np.array([end_id], dtype).tobytes(), 0, None, None
        files = [f"{path}/{kind}-{part:06d}-{name}.arrow" for kind in ("tokens", "index")]
        n_docs = 0
        for rows in _groups(batches, GROUP):
            if writer is None:
                sinks = [store.open_output_stream(f) for f in files]
                writer = SequenceWriter(sinks[0], dtype, sequence, batch)
                index = pa.ipc.new_file(sinks[1], pa.schema(
                    [rows.schema.field("doc_id"), ("start", pa.int64()), ("n_tokens", pa.int64())]))
            if not rows.num_rows:
                continue
            ids, counts = encoder.encode_joined([t or "" for t in rows.column("text").to_pylist()], end)
            writer.add(ids)
            ends = np.cumsum(counts) + start
            index.write_table(pa.table([rows.column("doc_id"), ends - counts, counts], names=["doc_id", "start", "n_tokens"]))
            n_docs, start = n_docs + rows.num_rows, int(ends[-1])
        if writer is not None:
            n_tokens = writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pylist([{
                "part": part, "tokens_path": files[0], "index_path": files[1], "n_docs": n_docs, "n_tokens": n_tokens,
                "sequence": sequence, "batch": batch}], schema=pa.schema(
                [("part", pa.int32()), ("tokens_path", pa.string()), ("index_path", pa.string()), ("n_docs", pa.int64()),
                 ("n_tokens", pa.int64()), ("sequence", pa.int32()), ("batch", pa.int32())]))

    manifest = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h").mapInArrow(
        write, MANIFEST)
    return stored(manifest.withColumn("folder", F.lit(folder)))


class TokenFile:
    """Random access to the ids of one token file through a memory map (or ranged reads of a remote store)."""

    def __init__(self, store, path: str, sequence: int, batch: int):
        from pyarrow import fs

        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader, self.room, self.at, self.flat = pa.ipc.open_file(source), sequence * batch, -1, None

    def _batch(self, number: int) -> np.ndarray:
        if number != self.at:
            self.at, self.flat = number, self.reader.get_batch(number).column(0).flatten().to_numpy()
        return self.flat

    def ids(self, start: int, n: int) -> np.ndarray:
        first, last = start // self.room, (start + n - 1) // self.room
        if first == last:
            return self._batch(first)[start - first * self.room:start - first * self.room + n]
        return np.concatenate([self._batch(b)[max(0, start - b * self.room):start + n - b * self.room]
                               for b in range(first, last + 1)])


def read_token_files(manifest: DataFrame, id_type: str, digest_only: bool = False) -> DataFrame:
    """Documents read back from the files: ``doc_id, start, n_tokens, ids_crc32`` and, unless
    ``digest_only``, ``ids``. ``start`` counts the ids of all documents before it, over all files.

    The manifest has one row per file, so numbering it is a small window.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    n_files = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                store, _ = _open_folder(row["folder"])
                tokens = TokenFile(store, row["tokens_path"], row["sequence"], row["batch"])
                with store.open_input_file(row["index_path"]) as source:
                    index = pa.ipc.open_file(source)
                    for number in range(index.num_record_batches):
                        part = index.get_batch(number)
                        starts, counts = part.column(1).to_numpy(), part.column(2).to_numpy()
                        ids = [tokens.ids(s, n) for s, n in zip(starts.tolist(), counts.tolist())]
                        crcs = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
                        out = [part.column(0), pa.array(starts + row["base"]), part.column(2), pa.array(crcs, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if not digest_only:
                            out, names = [*out, pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))], [*names, "ids"]
                        yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + (
        "" if digest_only else ", ids array<bigint>")
    return files.repartition(max(1, n_files)).mapInArrow(read, schema)
