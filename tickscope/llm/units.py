"""Substring dedup by hashing lines, paragraphs or clauses."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickscope.llm.common import bounded_batches

# Where a text is cut; what ends a unit stays with it.
LINES, PARAGRAPHS, CLAUSES = r"(?<=\n)", r"(?<=\n\n)", r"(?<=\n)|(?<=[.,;:!?] )"
MIN_WORDS = 20  # words that neighbouring repeated units have together before they go
HELD = 400_000  # digests that a task holds before it passes them on


def normalised(unit: str) -> str:
    return " ".join(unit.lower().split())


def pieces_of(text: str, cuts: re.Pattern) -> Iterator[tuple[int, str, str]]:
    """(start, piece, normalised unit or empty) of the pieces of a text; offsets count code points."""
    start = 0
    for piece in cuts.split(text):
        yield start, piece, normalised(piece)
        start += len(piece)


def digests_of(text: str, cuts: re.Pattern) -> Iterator[tuple[int, bytes]]:
    """(number, digest) of the units that are not blank; only those count."""
    plain = (p for p in map(normalised, cuts.split(text)) if p)
    for number, unit in enumerate(plain):
        yield number, hashlib.blake2b(unit.encode(), digest_size=12).digest()


def without_runs(text: str, cuts: re.Pattern, repeated: set[int], min_words: int) -> tuple[str, int, list[dict]]:
    """The text without runs of repeated units that have enough words, the number of units, and the places of removed units."""
    kept, spans, number = [], [], 0
    run: list[tuple[int, int, str]] = []  # start, words, piece; blank pieces between repeated units belong to the run

    def close() -> None:
        if sum(words for _, words, _ in run) >= min_words:
            spans.extend({"start": at, "end": at + len(piece.rstrip(" \n"))} for at, words, piece in run if words)
            kept.extend(piece for _, words, piece in run if not words)
        else:
            kept.extend(piece for _, _, piece in run)
        run.clear()

    for start, piece, plain in pieces_of(text, cuts):
        if not plain:
            run.append((start, 0, piece))
            continue
        if number in repeated:
            run.append((start, plain.count(" ") + 1, piece))
        else:
            close()
            kept.append(piece)
        number += 1
    close()
    return "".join(kept), number, spans


def repeated_units(rows: DataFrame, cuts: str, id_type: str) -> DataFrame:
    """``key, doc_id, unit`` of every unit that is not the first of its digest.

    ``rows`` has ``key, doc_id, text``. Units rank by (id, null last; key; number). A task compares its own units first: all
    but the least of a digest are repeats already, and only the least goes to the shuffle. So the most
    frequent unit of the corpus is shuffled once per task, not once per document.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        pattern = re.compile(cuts)
        for batch in batches:
            repeats = []
            for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text"))):
                rank = (doc_id is None, doc_id or 0 if not isinstance(doc_id, str) else doc_id), key
                for number, digest in digests_of(text or "", pattern):
                    mine = (*rank, number, doc_id)
                    other = held.setdefault(digest, mine)
                    if other[:3] == mine[:3]:
                        continue
                    if mine[:3] < other[:3]:
                        held[digest], mine = mine, other
                    repeats.append((None, mine))
            yield from records(repeats, batch)
            if len(held) > HELD:
                yield from records(held.items(), batch)
                held = {}
        if held:
            yield from records(held.items(), batch)

    def records(found, like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = list(found)
        for at in range(0, len(found), 20_000):
            part = found[at:at + 20_000]
            columns = [pa.array([d for d, _ in part], pa.binary()), pa.array([m[1] for _, m in part], pa.int64()),
                       pa.array([m[3] for _, m in part], like.schema.field("doc_id").type),
                       pa.array([m[2] for _, m in part], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "key", "doc_id", "unit"])

    units = rows.mapInArrow(local, f"digest binary, key bigint, doc_id {id_type}, unit int")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "unit")
    # Repeats found locally have no digest; each gets a group of its own by place, so that they spread.
    group = Window.partitionBy("digest", F.when(F.col("digest").isNull(), F.xxhash64("key", "unit")))
    marked = units.withColumn("first", F.min(rank).over(group))
    return marked.where(F.col("digest").isNull() | (F.col("first") != rank)).select("key", "doc_id", "unit")


def dedup_units(docs: DataFrame, cuts: str = CLAUSES, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Removes units of text that repeat earlier ones, where neighbouring repeats have at least ``min_words`` words together.

    ``cuts`` is ``LINES``, ``PARAGRAPHS`` or ``CLAUSES`` (lines, cut further behind ``.,;:!?`` and a space). A unit repeats
    another if both are equal after lower-casing and joining white space; the first of each digest stays: smallest id
    (null last), then order in the text. Every unit takes part in the digests, however short; a short repeat such as a common
    phrase only goes as part of a longer repeated run. With ``min_words=1`` every repeat goes.

    Returns per input row ``doc_id, text`` (what is left), ``n_units`` (that are not blank) and ``removed:
    array<struct<start, end>>``, the places of the removed units in the original text, ascending, in code points. The
    space or line end behind a removed unit goes with it. Blank units stay and interrupt nothing.

    A null text stays null, an empty one empty. Rows with the same id and text count as one document and lose the
    same units. Other columns are ignored. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    gone = repeated_units(rows.select("key", "doc_id", "text"), cuts, id_type).groupBy("key", "doc_id").agg(
        F.collect_set("unit").alias("gone")).withColumnsRenamed({"key": "of", "doc_id": "of_id"})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(cuts)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            texts, counts, spans = [], [], []
            for text, repeated in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                kept, n, removed = without_runs(text or "", pattern, set(repeated or ()), min_words)
                texts.append(kept if removed else text)
                counts.append(n)
                spans.append(removed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                                              pa.array(spans, pa.list_(span))], ["doc_id", "text", "n_units", "removed"])

    joined = rows.join(gone, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left")
    return joined.select("doc_id", "text", "gone").mapInArrow(
        cut, f"doc_id {id_type}, text string, n_units bigint, removed array<struct<start:bigint,end:bigint>>")
