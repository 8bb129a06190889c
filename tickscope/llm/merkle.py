"""Merkle dataset manifest: aligned subtrees of eight-way nodes in van Emde Boas order, one tree per group and one over them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import bounded_batches, stored
from tickscope.operators.ordering import number_rows

ARITY = 8
HEIGHT = 4  # hash levels of a block, which has 8**4 leaves
PATH = "array<struct<before:string,after:string>>"


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def n_nodes(levels: int) -> int:
    """Nodes of a full subtree with so many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache
def places(levels: int) -> list[np.ndarray]:
    """Per depth the place of node 0, 1, ... in van Emde Boas order.

    A subtree is split at half its levels: the top part lies first, then the bottom parts from left to right, each
    laid out the same way. So a path from leaf to root stays in few stretches of memory whatever a page or cache line holds.
    """
    if levels == 1:
        return [np.zeros(1, np.int64)]
    top = levels // 2
    bottom = levels - top
    starts = n_nodes(top) + np.arange(ARITY**top) * n_nodes(bottom)
    return [*places(top), *((starts[:, None] + inner[None, :]).ravel() for inner in places(bottom))]


def build_block(leaves: list[str], height: int) -> bytes:
    """The digests of a block's nodes in van Emde Boas order; nodes that are not there are zero."""
    at, tree = places(height + 1), np.zeros((n_nodes(height + 1), 32), np.uint8)
    row = leaves
    for depth in range(height, -1, -1):
        tree[at[depth][:len(row)]] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        row = [hashed("".join(row[k:k + ARITY])) for k in range(0, len(row), ARITY)]
    return tree.tobytes()


def block_paths(tree: bytes, height: int, n: int) -> list[list[dict]]:
    """For each leaf of a block: the siblings before and after it, level by level up to the block's root."""
    at, digits = places(height + 1), tree.hex()
    paths: list[list[dict]] = [[]]
    counts = [n]
    for _ in range(height):
        counts.append(-(-counts[-1] // ARITY))
    for depth in range(1, height + 1):
        below = []
        for run, above in enumerate(paths):
            first = run * ARITY
            members = [digits[p * 64:p * 64 + 64] for p in at[depth][first:min(first + ARITY, counts[height - depth])].tolist()]
            below += [[{"before": "".join(members[:k]), "after": "".join(members[k + 1:])}, *above] for k in range(len(members))]
        paths = below
    return paths


def height_of(block: int, n: int, most: int) -> int:
    """Hash levels of a block: the first block of a group is the only one unless it is full, later ones are never alone."""
    height = 0
    while ARITY**height < n:
        height += 1
    return most if block else height


@dataclass
class Manifest:
    """Blocks by level, from the leaves up; ``groups`` is the tree over the groups' subroots."""

    levels: list[DataFrame]
    groups: list[DataFrame]
    id_type: str
    height: int


def _trees(nodes: DataFrame, kind: str, most: int) -> list[DataFrame]:
    """Blocks ``grp, block, height, n, root, tree, entries`` of all groups, then blocks over their roots, until each group has one.

    ``nodes`` has ``grp, rank`` (dense from 0) ``, digest, item`` (of type ``kind``) and ``other``, a second digest or null.
    Only block roots go on to the next level, one row for ``8**most`` nodes.
    """
    levels, size = [], ARITY**most
    entry = f"struct<slot:int,digest:string,item:{kind},other:string>"
    while True:
        cells = nodes.withColumn("block", F.expr(f"rank div {size}")).groupBy("grp", "block").agg(F.array_sort(F.collect_list(
            F.struct((F.col("rank") % size).cast("int").alias("slot"), "digest", "item", "other"))).alias("entries"))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    digests = one.column("entries").flatten().field("digest").to_pylist()
                    height = height_of(one.column("block")[0].as_py(), len(digests), most)
                    tree = build_block(digests, height)
                    yield pa.RecordBatch.from_arrays(
                        [one.column("grp"), one.column("block"), pa.array([height], pa.int32()), pa.array([len(digests)], pa.int32()),
                         pa.array([tree[:32].hex()]), pa.array([tree], pa.binary()), one.column("entries")],
                        ["grp", "block", "height", "n", "root", "tree", "entries"])

        blocks = stored(cells.select("grp", "block", "entries").mapInArrow(
            build, f"grp string, block bigint, height int, n int, root string, tree binary, entries array<{entry}>"))
        levels.append(blocks)
        if not blocks.agg(F.max("block")).first()[0]:
            return levels
        entry, kind = "struct<slot:int,digest:string,item:string,other:string>", "string"
        nothing = F.lit(None).cast("string")
        nodes = blocks.select("grp", F.col("block").alias("rank"), F.col("root").alias("digest"), nothing.alias("item"), nothing.alias("other"))


def _field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _folded(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def leaf_digests(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``grp, item`` (the id) ``, digest, other``: the leaf of each row, and its leaf with the text's A-Z lower-cased where 3 divides
    the CRC32 of the id (null elsewhere). ``grp`` is ``:`` and the language, or ``-`` for null, which sorts first."""
    head = F.concat(*(_field(F.col(f"`{c}`")) for c in (id_col, "source", "lang", "n_chars")))
    text = F.col("text")
    picked = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit(":"), F.col("lang")), F.lit("-")).alias("grp"), F.col(f"`{id_col}`").alias("item"),
        F.sha2(F.concat(head, _field(text)), 256).alias("digest"),
        F.when(picked, F.sha2(F.concat(head, _field(_folded(text))), 256)).alias("other"))


def build_manifest(docs: DataFrame, id_col: str = "doc_id", height: int = HEIGHT) -> Manifest:
    """The trees of a documents table (``id, source, lang, n_chars, text``); other columns are ignored.

    Each row is a leaf. Leaves of a language ascend by id (null first), ties by digest; runs of eight nodes are hashed until
    one is left, and so are the subroots of the languages. Leaves are numbered within range
    partitions and cut into aligned blocks, so a language with most rows spreads over tasks like any other. A block is one
    row of a stored table; a lost executor costs the blocks it was building.

    Null fields hash as ``-``; an empty text is not a null one. Equal rows are leaves of their own. An empty table has no trees.
    """
    bounded_batches(docs.sparkSession, 64)
    leaves = stored(leaf_digests(docs, id_col))
    kind = leaves.schema["item"].dataType.simpleString()
    # Always by range partitions: one language may hold most rows.
    ranked = number_rows(leaves, ["grp"], ["item", "digest"], "rank", limit=0, largest=1).withColumn("rank", F.col("rank") - 1)
    levels = _trees(ranked, kind, height)
    subroots = number_rows(levels[-1].select(F.col("grp").alias("item"), F.col("root").alias("digest")), [], ["item"], "rank")
    groups = _trees(subroots.select(F.lit("").alias("grp"), (F.col("rank") - 1).alias("rank"), "digest", "item",
                                    F.lit(None).cast("string").alias("other")), "string", height)
    return Manifest(levels, groups, kind, height)


def _with_paths(blocks: DataFrame, outer: DataFrame, most: int, leaf_kind: str | None = None) -> DataFrame:
    """The path of every entry of the blocks; ``outer`` (``grp, block, path, subroot, root``) leads from a block to the root.

    Without ``leaf_kind``, gives the next ``outer``: ``grp, block, item, path, subroot, root``. With it, gives the proofs of the leaves.
    """
    joined = blocks.drop("root").join(outer, ["grp", "block"]).select("grp", "block", "height", "n", "tree", "entries", "path", "subroot", "root")
    size = ARITY**most
    path_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                grp, block, height, n, tree, above, subroot, root = (
                    one.column(c)[0].as_py() for c in ("grp", "block", "height", "n", "tree", "path", "subroot", "root"))
                entries = one.column("entries").flatten()
                paths = block_paths(tree, height, n)
                for start in range(0, n, 512):
                    mine, some = entries.slice(start, 512), [p + above for p in paths[start:start + 512]]
                    if leaf_kind is None:
                        slots = mine.field("slot").to_pylist()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([grp] * len(some)), pa.array([block * size + s for s in slots], pa.int64()), mine.field("item"),
                             pa.array(some, path_type), pa.array([subroot] * len(some), pa.string()), pa.array([root] * len(some), pa.string())],
                            ["grp", "block", "item", "path", "subroot", "root"])
                        continue
                    leaves, proofs, folded = mine.field("digest").to_pylist(), [], []
                    for leaf, other, path in zip(leaves, mine.field("other").to_pylist(), some):
                        node = other or leaf
                        for step in path:
                            node = hashed(step["before"] + node + step["after"])
                        folded.append(node)
                        proofs.append(hashed("".join(step["before"] + step["after"] for step in path)))
                    yield pa.RecordBatch.from_arrays(
                        [mine.field("item"), pa.array(leaves), pa.array([subroot] * len(some)), pa.array([root] * len(some)),
                         pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])],
                        ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    if leaf_kind is None:
        return joined.mapInArrow(expand, f"grp string, block bigint, item string, path {PATH}, subroot string, root string")
    return joined.mapInArrow(expand, f"doc_id {leaf_kind}, leaf string, subroot string, root string, proof_sha256 string, "
                                     "folded_root string, verified boolean")


def proofs(manifest: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per leaf.

    Paths are handed down from the root: a block's siblings are read from its stored subtree by address, and each entry's path
    becomes the outer path of the block below. ``folded_root`` is hashed up the path from the changed leaf where the manifest
    has one, from the leaf itself elsewhere.
    """
    nothing = F.array().cast(PATH)
    unknown = F.lit(None).cast("string")
    outer = manifest.groups[-1].select("grp", "block", nothing.alias("path"), unknown.alias("subroot"), "root")
    for blocks in reversed(manifest.groups):
        outer = _with_paths(blocks, outer, manifest.height)
    subroots = manifest.levels[-1].select("grp", F.col("root").alias("own"))
    outer = stored(outer.select(F.col("item").alias("grp"), "path", "root")).join(subroots, "grp").select(
        "grp", F.lit(0).cast("long").alias("block"), "path", F.col("own").alias("subroot"), "root")
    for blocks in reversed(manifest.levels[1:]):
        outer = _with_paths(blocks, outer, manifest.height).drop("item")
    return _with_paths(manifest.levels[0], outer, manifest.height, manifest.id_type)
