import random

import numpy as np

from tickscope.llm.pieces import TextEncoder, load_tokenizer
from tickscope.llm.queries import tokenizer_path


def made():
    tokenizer = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    return tokenizer, TextEncoder(tokenizer, np.dtype("<u2"))


def test_joined_ids_are_those_of_the_library():
    tokenizer, encoder = made()
    rng = random.Random(3)
    words = ["word", "Word,", "end.", "so!!", "cash$$$", "five....", "it's", "we'll,", "'s", "'!", "a.b;", "x1!", "12.5", "-", "?!", "é", "Éaux###", "日本!", "語",
             "Ġa", "ʼn,", "ǅ", "ª.", "\t", "a\tb", " ", "tab\t", "\U00031350", "\U00031350!!", "a\U00011f04b", "<|endoftext|>", "", "\n", "a\nb", "long" * 30]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    texts += ["", " ", "  ", "\n", " a", "a ", "a  b", "a b\nc d", "a\n\nb c", "\na", *words, *(f"one {w} two" for w in words), *(f"one {w}" for w in words)]
    end = np.array([2], "<u2").tobytes()
    for part in (texts, texts[::-1], [""], ["a  b"]):  # the second time from what the caches keep
        ids, counts = encoder.encode_joined(part, end)
        got = [x.tolist() for x in np.split(np.frombuffer(ids, "<u2"), np.cumsum(counts)[:-1])]
        assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in part]


def test_each_distinct_piece_is_looked_up_once(monkeypatch):
    """Looking up every word of every text took most of the time of op6_token_files."""
    _, encoder = made()
    asked = []
    values = encoder.inner.values
    monkeypatch.setattr(encoder.inner, "values", lambda pieces: asked.extend(pieces) or values(pieces))
    encoder.encode_joined(["the same words again and again and again"] * 500 + ["other words, again"], b"\2\0")
    assert sorted(asked) == ["again", "and", "same", "words", "words", "words,"]  # once more as the core of "words,"


def test_a_run_of_punctuation_behind_a_known_word_needs_no_call_for_the_word(monkeypatch):
    tokenizer, encoder = made()
    encoder.encode_joined(["a word of praise!!"], b"\2\0")
    calls = []
    monkeypatch.setattr(encoder.inner, "_encode", lambda pieces: calls.append(pieces))
    monkeypatch.setattr(encoder.inner, "_words", lambda pieces, *a: calls.append(pieces))
    ids, _ = encoder.encode_joined(["a word!! of praise"], b"\2\0")
    assert not calls and np.frombuffer(ids, "<u2").tolist() == [*tokenizer.encode("a word!! of praise").ids, 2]
