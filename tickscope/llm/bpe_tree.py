"""BPE encoding and decoding; long texts and long unsplit text are encoded in parts that are joined up a tree.

Long texts are cut at any character into leaves, which are encoded in parallel. Around each join a window grows, over
whole leaves if it must, until it ends at a space on both sides; pieces between spaces are encoded alone, so both
sides agree there exactly. A piece without a space that is itself long is cut into leaves as well:

Joining rests on a property of byte-pair encodings: a token sequence is the encoding of its text if and
only if each two neighbours are the encoding of theirs. So when a window around a join is encoded
again and its outer tokens agree with those of both halves, the spliced sequence is the encoding
of the whole; until then the window grows.
"""

from __future__ import annotations

import hashlib
import json
import re
import weakref
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import bounded_batches, give_back_memory, map_cells, stored
from tickscope.llm.pieces import PieceCache, load_tokenizer

LEAF = 2048  # characters of a leaf; a pre-token with more is split
TEXT_BYTES = 16_384  # a text with more is cut into leaves of TEXT_LEAF characters
TEXT_LEAF = 4096
WINDOW = 4  # tokens on each side of a join at first


JOINTS = (b"", " ", " ")  # between the ids, the decimal ids and the decoded texts of neighbours


def _add(a: tuple, b: tuple) -> tuple:
    return tuple(by.join(parts) for by, parts in zip(JOINTS, zip(a, b))) if a[0] else b


class Codec:
    """Encoder of pieces and of fragments of pre-tokens, for one worker.

    It supports tokenizers whose pre-tokens hold no space (a space parts them and is dropped). With ``texts`` the
    decimal ids and the decoded text of each piece are kept beside its ids.
    """

    def __init__(self, path: str, leaf: int = LEAF, texts: bool = True):
        from tokenizers import models

        self.nothing = (b"", "", "") if texts else (b"",)
        self.tokenizer, self.leaf = load_tokenizer(path), leaf
        self.token = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.cache = PieceCache(self.tokenizer, self._values, _add, border=suffix)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        plain = {"vocab": model["vocab"], "merges": merges, "cache_capacity": 0}
        self.inside = models.BPE(**plain)
        self.ending = models.BPE(**plain, end_of_word_suffix=suffix) if suffix else self.inside
        self.suffix = suffix
        self.specials = re.compile("|".join(map(re.escape, self.cache.specials)) or r"(?!)")

    def _values(self, ids: np.ndarray, begins: list[int], ends: list[int]) -> list[tuple]:
        packed, each = ids.astype(np.int32).tobytes(), ids.tolist()
        if len(self.nothing) == 1:
            return [(packed[4 * b:4 * e],) for b, e in zip(begins, ends)]
        decimal = list(map(str, each))
        return [(packed[4 * b:4 * e], " ".join(decimal[b:e]), self.decoded(each[b:e])) for b, e in zip(begins, ends)]

    def decoded(self, ids: list[int]) -> str:
        """As ``decode(ids, skip_special_tokens=False)``; without a decoder that joins tokens by a space."""
        if self.tokenizer.decoder is None:
            return " ".join([self.token[i] for i in ids])
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def simple(self, texts: list[str]) -> Iterator[tuple]:
        """Per text without long pieces: its ids as bytes, and with ``texts`` its decimal ids and its decoded text."""
        split = [[p for p in t.replace("\n", " ").split(" ") if p] for t in texts]
        values, at = self.cache.values([p for pieces in split for p in pieces]), 0
        for pieces in split:
            own = [v for v in values[at:at + len(pieces)] if v[0]]
            at += len(pieces)
            yield tuple(by.join(parts) for by, parts in zip(JOINTS, zip(*own))) if own else self.nothing

    def units(self, text: str) -> Iterator[tuple[list[int] | None, str]]:
        """The text in order: (ids, "") of what is short, (None, byte-level string) of a long pre-token."""
        upto = 0
        for m in [*self.specials.finditer(text), None]:
            for piece in text[upto:m.start() if m else len(text)].split(" "):
                if len(piece) <= self.leaf:
                    yield (np.frombuffer(self.cache.values([piece])[0][0], np.int32).tolist() if piece else []), ""
                    continue
                normal = self.tokenizer.normalizer.normalize_str(piece) if self.tokenizer.normalizer else piece
                for token, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                    if len(token) > self.leaf:
                        yield None, token
                    else:
                        yield self.fragment(token, True), ""
            if m:
                yield [self.tokenizer.token_to_id(m[0])], ""
                upto = m.end()

    def fragment(self, text: str, ends: bool) -> list[int]:
        """Ids of a part of a pre-token; ``ends``: the pre-token ends here."""
        return [t.id for t in (self.ending if ends else self.inside).tokenize(text)]

    def text_of(self, ids: list[int]) -> str:
        joined = "".join(self.token[i] for i in ids)
        return joined.removesuffix(self.suffix) if self.suffix else joined

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """The encoding of two neighbouring fragments from their encodings."""
        width = WINDOW
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            window = self.fragment(self.text_of(left[len(left) - a:]) + self.text_of(right[:b]), ends and b == len(right))
            fits_left = a == len(left) or window[0] == left[len(left) - a]
            fits_right = b == len(right) or window[-1] == right[b - 1]
            if fits_left and fits_right:
                return left[:len(left) - a] + window + right[b:]
            width *= 2


_codecs: weakref.WeakSet[Codec] = weakref.WeakSet()


@lru_cache(maxsize=2)
def shared_codec(path: str, leaf: int, texts: bool) -> Codec:
    """The codec of this worker process; its pieces stay for one task, see ``forgetting``."""
    codec = Codec(path, leaf, texts)
    _codecs.add(codec)
    return codec


def forgetting(encode: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``encode`` of one task; afterwards the worker drops the pieces it met. It idles while the executor runs other
    stages, which need the memory, and most pieces of a task are new to the worker anyway."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from encode(batches)
        finally:
            forget_pieces()

    return run


def forget_pieces() -> None:
    """Drops the pieces of the codecs of this process; a function of the module, so that it sees the worker's own."""
    for codec in _codecs:
        codec.cache.forget()
    give_back_memory()


def _id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def _long(text, leaf: int):
    """The text holds more than ``leaf`` characters without a space between them."""
    return (F.octet_length(text) > leaf) & text.rlike(f"(^| )[^ ]{{{leaf + 1}}}")


def _pick(rows: DataFrame, which: str, leaf: int, text_bytes: int) -> DataFrame:
    """The rows that take one of three ways: ``whole``, ``cut`` (long texts) or ``deep`` (long unsplit text in them)."""
    deep, cut = _long(F.col("text"), leaf), F.octet_length("text") > text_bytes
    return rows.where({"deep": deep, "cut": cut & ~deep, "whole": ~deep & ~cut}[which])


# Part of a text: (text before its first space, ids of its pieces, text behind its last space); the
# last is None where it has no space, and all of it stands in the first.
Part = tuple[str, list[bytes], str | None]


def leaf_parts(codec: Codec, texts: list[str]) -> list[Part]:
    cuts = []
    for text in texts:
        spaced = text.replace("\n", " ")
        cuts.append((text, spaced.find(" "), spaced.rfind(" ")))
    encoded = codec.simple([t[a:b] if a >= 0 else "" for t, a, b in cuts])
    return [(t[:a], [ids], t[b + 1:]) if a >= 0 else (t, [], None) for (t, a, b), (ids, *_) in zip(cuts, encoded)]


def join_parts(codec: Codec, parts: list[Part]) -> bytes:
    """Ids of a whole text from its parts in order, joined in pairs level by level."""
    while len(parts) > 1:
        pairs = list(zip(parts[::2], parts[1::2]))
        # the text around each join, up to a space on both sides; where a side has none, it grows on the next level
        closed = [a[2] is not None and b[2] is not None for a, b in pairs]
        windows = codec.simple([a[2] + b[0] for (a, b), known in zip(pairs, closed) if known])
        joined: list[Part] = []
        for (a, b), known in zip(pairs, closed):
            if known:
                joined.append((a[0], [*a[1], next(windows)[0], *b[1]], b[2]))
            elif a[2] is None:
                joined.append((a[0] + b[0], b[1], b[2]))
            else:
                joined.append((a[0], a[1], a[2] + b[0]))
        parts = joined + parts[2 * len(pairs):]
    if not parts:
        return b""
    head, ids, tail = parts[0]
    first, last = codec.simple([head, tail or ""])
    return b"".join([first[0], *ids, last[0]])


def encoded_leaves(rows: DataFrame, tokenizer_path: str, leaf: int = LEAF, text_leaf: int = TEXT_LEAF,
                   texts: bool = False) -> DataFrame:
    """``doc_id, parts`` of texts cut at any character into leaves, which are dealt over all tasks and encoded in parallel.

    One row per input row; repeated and null ids are kept apart by their place in the scan. ``join_cut`` makes the ids of
    the parts. No stretch without a space in the texts may exceed ``leaf`` characters. ``texts``: which codec the workers share.
    """
    kind = _id_type(rows, "doc_id")
    at = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def cut(batches):
        for batch in batches:
            source, nodes, pieces = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for node, start in enumerate(range(0, len(text), text_leaf)):
                    source.append(k)
                    nodes.append(node)
                    pieces.append(text[start:start + text_leaf])
            own = batch.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own.column("row"), own.column("doc_id"), pa.array(nodes, pa.int32()), pa.array(pieces, pa.string())],
                ["row", "doc_id", "node", "text"])

    def encode(batches):
        codec = shared_codec(tokenizer_path, leaf, texts)
        for batch in batches:
            heads, ids, tails = zip(*leaf_parts(codec, batch.column("text").to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "node")), pa.array(heads, pa.string()),
                 pa.array([b"".join(i) for i in ids], pa.binary()), pa.array(tails, pa.string())],
                ["row", "doc_id", "node", "head", "ids", "tail"])

    leaves = at.mapInArrow(cut, f"row bigint, doc_id {kind}, node int, text string").repartition("row", "node")
    encoded = leaves.mapInArrow(forgetting(encode), f"row bigint, doc_id {kind}, node int, head string, ids binary, tail string")
    # the leaves of one text, whose ids make one row in the end
    whole = encoded.groupBy("row").agg(
        F.any_value("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.struct("node", "head", "ids", "tail"))).alias("parts"))
    return whole.select("doc_id", "parts")


def join_cut(codec: Codec, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids of each text of a batch of ``encoded_leaves``."""
    for parts in batch.column("parts").to_pylist():
        yield np.frombuffer(join_parts(codec, [(p["head"], [p["ids"]], p["tail"]) for p in parts]), np.int32)


def encode_long(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF, id_col: str = "doc_id",
                text_col: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id, ids`` of documents that hold unsplit text longer than a leaf.

    Their long pre-tokens are cut into leaves, which are dealt over all tasks and encoded in parallel;
    each round then joins neighbours, so a pre-token of n leaves takes log2(n) rounds. At last the parts
    of each document are put together.
    """
    kind = _id_type(docs, id_col)
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                              F.monotonically_increasing_id().alias("row")))

    def cut(batches):
        codec = shared_codec(tokenizer_path, leaf, texts)
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                out, held = [], []
                for ids, token in codec.units(text):
                    if ids is not None:
                        held += ids
                        continue
                    out += [(held, None), (None, token)]
                    held = []
                for unit, (ids, token) in enumerate([*out, (held, None)]):
                    leaves = [""] if token is None else [token[i:i + leaf] for i in range(0, len(token), leaf)]
                    for start in range(0, len(leaves), 64):
                        yield pa.RecordBatch.from_pylist(
                            [{"row": row, "unit": unit, "node": k, "ids": ids, "text": leaves[k], "ends": k == len(leaves) - 1}
                             for k in range(start, min(start + 64, len(leaves)))], schema=cut_schema)

    cut_schema = pa.schema([("row", pa.int64()), ("unit", pa.int32()), ("node", pa.int64()),
                            ("ids", pa.list_(pa.int32())), ("text", pa.string()), ("ends", pa.bool_())])
    leaves = rows.mapInArrow(forgetting(cut), "row bigint, unit int, node bigint, ids array<int>, text string, ends boolean")

    def encode(batches):
        codec = shared_codec(tokenizer_path, leaf, texts)
        for batch in batches:
            ids = [i if i is not None else codec.fragment(t, e) for i, t, e in zip(
                batch.column("ids").to_pylist(), batch.column("text").to_pylist(), batch.column("ends").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "unit", "node")), pa.array(ids, pa.list_(pa.int32())), batch.column("ends")],
                ["row", "unit", "node", "ids", "ends"])

    nodes = stored(leaves.repartition("row", "unit", "node").mapInArrow(
        forgetting(encode), "row bigint, unit int, node bigint, ids array<int>, ends boolean"))
    joined_schema = pa.schema([("row", pa.int64()), ("unit", pa.int32()), ("node", pa.int64()),
                               ("ids", pa.list_(pa.int32())), ("ends", pa.bool_())])

    def joiner():
        codec = shared_codec(tokenizer_path, leaf, texts)

        def join_pair(cell: pa.Table):
            first, *others = sorted(cell.to_pylist(), key=lambda r: r["node"])
            for other in others:
                first |= {"ids": codec.join(first["ids"], other["ids"], other["ends"]), "ends": other["ends"]}
            yield pa.RecordBatch.from_pylist(
                [{c: first[c] for c in joined_schema.names} | {"node": first["node"] // 2}], schema=joined_schema)

        return join_pair

    widest = nodes.agg(F.max("node")).first()[0] or 0
    while widest > 0:
        pair = F.concat_ws(":", "row", "unit", F.floor(F.col("node") / 2).cast("long"))
        nodes = stored(map_cells(nodes.withColumn("pair", pair), "pair", joiner,
                                 "row bigint, unit int, node bigint, ids array<int>, ends boolean"))
        widest //= 2
    whole = nodes.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("unit", "ids"))).alias("parts"))
    return rows.join(whole, "row").select(F.col("doc_id").cast(kind), F.flatten("parts.ids").alias("ids"))


def encode_documents(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF, id_col: str = "doc_id",
                     text_col: str = "text", text_bytes: int = TEXT_BYTES, text_leaf: int = TEXT_LEAF) -> DataFrame:
    """``doc_id, ids`` of every whole text, one row per input row, as the tokenizers library encodes.

    Short texts are encoded piece by piece where they are read, texts above ``text_bytes`` through the tree of
    ``encoded_leaves``, and texts with a stretch of more than ``leaf`` characters without a space through that of
    ``encode_long``. A null or empty text has no ids; null ids and repeated rows are kept, other columns are
    ignored. Only parts of long texts are shuffled.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))

    def encode(batches):
        codec = shared_codec(tokenizer_path, leaf, False)
        for batch in batches:
            ids = [np.frombuffer(i, np.int32) for i, *_ in codec.simple(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    def join(batches):
        for batch in batches:
            ids = list(join_cut(shared_codec(tokenizer_path, leaf, False), batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    schema = f"doc_id {_id_type(docs, id_col)}, ids array<int>"
    cut = encoded_leaves(_pick(rows, "cut", leaf, text_bytes), tokenizer_path, leaf, text_leaf).mapInArrow(forgetting(join), schema)
    deep = encode_long(_pick(rows, "deep", leaf, text_bytes), tokenizer_path, leaf)
    return _pick(rows, "whole", leaf, text_bytes).mapInArrow(forgetting(encode), schema).unionByName(cut).unionByName(deep)


DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digest(batch: pa.RecordBatch, rows: Iterator[tuple[int, str, str]]) -> pa.RecordBatch:
    counts, decimal, decoded = [], [], []
    for n, ids, text in rows:
        counts.append(n)
        decimal.append(hashlib.sha256(ids.encode()).hexdigest())
        decoded.append(hashlib.sha256(text.encode()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(decimal, pa.string()), pa.array(decoded, pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` decoded from ``ids``, special tokens included; no ids or null ids decode to an empty text."""

    def decode(batches):
        tokenizer = load_tokenizer(tokenizer_path)
        for batch in batches:
            texts = tokenizer.decode_batch([i or [] for i in batch.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {_id_type(encoded, 'doc_id')}, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF, text_bytes: int = TEXT_BYTES,
                       text_leaf: int = TEXT_LEAF) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoding and decoding in one pass, so that ids of
    short pieces, which are cached with their decoded texts, need not travel."""
    bounded_batches(docs.sparkSession)
    kind = _id_type(docs, "doc_id")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def short(batches):
        codec = shared_codec(tokenizer_path, leaf, True)
        for batch in batches:
            yield _digest(batch, ((len(ids) // 4, decimal, decoded)
                                  for ids, decimal, decoded in codec.simple(batch.column("text").to_pylist())))

    def digested(tokenizer, batch, ids):
        return _digest(batch, ((len(i), " ".join(map(str, i)), tokenizer.decode(i, skip_special_tokens=False)) for i in ids))

    # joined and digested by one worker: a second one in the same task would hold the tokenizer and its caches again
    def join(batches):
        for batch in batches:
            codec = shared_codec(tokenizer_path, leaf, True)
            yield digested(codec.tokenizer, batch, (ids.tolist() for ids in join_cut(codec, batch)))

    def long(batches):
        for batch in batches:
            yield digested(shared_codec(tokenizer_path, leaf, True).tokenizer, batch, batch.column("ids").to_pylist())

    schema = f"doc_id {kind}, {DIGEST}"
    cut = encoded_leaves(_pick(rows, "cut", leaf, text_bytes), tokenizer_path, leaf, text_leaf, texts=True)
    deep = encode_long(_pick(rows, "deep", leaf, text_bytes), tokenizer_path, leaf, texts=True)
    whole = _pick(rows, "whole", leaf, text_bytes).mapInArrow(forgetting(short), schema)
    return whole.unionByName(cut.mapInArrow(forgetting(join), schema)).unionByName(deep.mapInArrow(forgetting(long), schema))
