import random
import zlib

import numpy as np
import pytest

from tickscope.llm import bpe_tree, token_files
from tickscope.llm.queries import tokenizer_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def library(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def odd_texts():
    rng = random.Random(11)
    alphabets = ["ab", "aaaaab", "abcdefghijklmnopqrstuvwxyz  ", "thein gr\n", "éàüsth ", "ABCdé1!. <|endoftext|>", "日本語aé", "  \n\t x",
                 "İſK ΣΑς", "it's we'll "]
    return ["".join(rng.choice(a) for _ in range(rng.randint(0, 300))) for a in alphabets for _ in range(25)]


def test_whole_texts_encode_as_the_library_does(documents, messy):
    rows = [*messy, *((100 + k, t) for k, t in enumerate(odd_texts()))]
    tokenizer = library(WORD)
    wanted = {}
    for i, t in rows:
        wanted.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids)
    encoded = bpe_tree.encode_documents(documents(rows), tokenizer_path(WORD), leaf=32)
    got = {}
    for r in encoded.collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}
    for r in bpe_tree.decode_documents(encoded.where("doc_id >= 100"), tokenizer_path(WORD)).collect():
        assert r.text == tokenizer.decode(wanted[r.doc_id][0], skip_special_tokens=False)
    assert bpe_tree.encode_documents(documents([]), tokenizer_path(WORD)).collect() == []


def test_unsplit_text_is_joined_up_the_tree(documents):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("abcdeghinorst") for _ in range(n))) for k, n in enumerate([2048, 2049, 9000, 50_000])]
    rows += [(10, "x y " + "ab" * 3000 + " z " + "é," * 4000), (None, "q" * 7000)]
    tokenizer = library(WORD)
    wanted = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.ids for r in bpe_tree.encode_documents(documents(rows), tokenizer_path(WORD)).collect()} == wanted
    digests = {r.doc_id: r for r in bpe_tree.round_trip_digests(documents(rows), tokenizer_path(WORD)).collect()}
    assert {i: r.n_tokens for i, r in digests.items()} == {i: len(x) for i, x in wanted.items()}


def test_joins_agree_with_the_whole():
    codec, rng = bpe_tree.Codec(tokenizer_path(WORD), 8), random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(["ab", "thein", "etaoinshr"])) for _ in range(rng.randint(2, 120)))
        cut = rng.randint(1, len(text) - 1)
        joined = codec.join(codec.fragment(text[:cut], False), codec.fragment(text[cut:], True), True)
        assert joined == codec.fragment(text, True)


@pytest.mark.parametrize("sequence,batch", [(8, 2), (1024, 256)])
def test_token_files_come_back(documents, messy, sequence, batch):
    rows = [*messy, *((100 + k, t) for k, t in enumerate(odd_texts()))]
    manifest = token_files.write_token_files(documents(rows), tokenizer_path(BYTE), 2, sequence=sequence, batch=batch)
    got = token_files.read_token_files(manifest, "bigint").collect()
    tokenizer = library(BYTE)
    wanted = sorted(((i is not None, i or 0), tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    ours = sorted(((r.doc_id is not None, r.doc_id or 0), r.ids) for r in got)
    assert ours == wanted
    start = 0
    for r in sorted(got, key=lambda r: r.start):  # ascending ids, nulls first, without gaps
        assert r.start == start and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_sequences_have_equal_length_and_masks(documents):
    import pyarrow as pa

    manifest = token_files.write_token_files(documents([(1, "hello there"), (2, "more text here")]), tokenizer_path(BYTE), 2,
                                             sequence=4, batch=2).collect()
    for row in manifest:
        table = pa.ipc.open_file(pa.memory_map(row.tokens_path)).read_all()
        assert table.schema.field("ids").type.list_size == 4 and table.schema.field("ids").type.value_type == pa.uint16()
        assert sum(m for mask in table.column("mask").to_pylist() for m in mask) == row.n_tokens
    empty = token_files.write_token_files(documents([]), tokenizer_path(BYTE), 2)
    assert token_files.read_token_files(empty, "bigint").collect() == []


@pytest.mark.parametrize("text_leaf", [1, 7, 64])
def test_long_texts_are_cut_anywhere_and_joined(documents, messy, text_leaf):
    rows = [*messy, *((100 + k, t) for k, t in enumerate(odd_texts())), (100, "a repeated id " * 9)]
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in rows]
    tokenizer = library(WORD)
    wanted = sorted((i is not None, i or 0, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    docs = documents(rows)
    encoded = bpe_tree.encode_documents(docs, tokenizer_path(WORD), leaf=400, text_bytes=40, text_leaf=text_leaf)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in encoded.collect()) == wanted
    whole = bpe_tree.round_trip_digests(docs, tokenizer_path(WORD), text_bytes=1 << 30).collect()
    cut = bpe_tree.round_trip_digests(docs, tokenizer_path(WORD), text_bytes=40, text_leaf=text_leaf).collect()
    assert sorted(map(str, cut)) == sorted(map(str, whole))


def test_parts_join_in_any_cut():
    codec, rng, tokenizer = bpe_tree.Codec(tokenizer_path(WORD), 2048), random.Random(6), library(WORD)
    for text in odd_texts():
        places = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randint(0, 12))))
        pieces = [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]
        joined = bpe_tree.join_parts(codec, bpe_tree.leaf_parts(codec, pieces))
        assert np.frombuffer(joined, np.int32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_workers_keep_no_pieces_after_a_task(documents, spark):
    rows = [(k, " ".join(f"word{k}x{j}" for j in range(50))) for k in range(40)]
    rows += [(100, "a long text " * 3000), (101, "q" * 7000)]

    def held(batches):
        import gc
        import os

        import pyarrow as pa

        from tickscope.llm.bpe_tree import Codec

        for _ in batches:
            pass
        caches = [c.cache for c in gc.get_objects() if isinstance(c, Codec)]
        pieces = sum(len(c.young) + len(c.old) for c in caches)
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "caches": [len(caches)], "pieces": [pieces]})

    for job in (bpe_tree.encode_documents, bpe_tree.round_trip_digests):
        assert job(documents(rows), tokenizer_path(WORD)).count() == 42
        workers = spark.range(0, 16, 1, 16).mapInArrow(held, "pid long, caches long, pieces long").collect()
        assert sum(w.caches for w in workers) and not any(w.pieces for w in workers)


def test_a_codec_without_texts_gives_the_same_ids():
    full, narrow = (bpe_tree.Codec(tokenizer_path(WORD), 32, texts) for texts in (True, False))
    texts = [t.replace("\n", " ") for t in odd_texts()]
    assert [i for i, *_ in full.simple(texts)] == [i for i, in narrow.simple(texts)]
