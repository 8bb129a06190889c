"""Encoding through a cache of space-delimited pieces, exactly as the tokenizers library encodes.

Pre-tokens of the supported tokenizers never reach from a non-space character over a space, so a text
splits at single spaces and equal pieces have equal ids. A worker keeps the pieces it met lately and
asks the library only for new ones, many in one call, parted by a special token.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 64  # longer pieces are not kept
GENERATION = 300_000  # pieces of the young half of the cache; the old half is dropped when it is full
CALL = 4096  # pieces in one call of the library
TEXT = 128  # words in one text of such a call
TAILS = ",.;:!?"  # one of these behind a letter is a pre-token of its own
TAIL = 3  # longer runs of punctuation behind a word are not cut off
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch  # letters in every version of Unicode


def load_tokenizer(path: str):
    """The tokenizer of the file, without its truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _core(piece: str) -> str:
    """The piece without one punctuation mark behind a letter, or nothing if it has none."""
    return piece[:-1] if len(piece) > 1 and piece[-1] in TAILS and piece[-2].isalpha() else ""


def _core_of_run(piece: str) -> str:
    """The piece without a run of punctuation behind a letter, where such a run is one pre-token."""
    core = piece.rstrip(string.punctuation)
    return core if len(piece) - TAIL <= len(core) < len(piece) and LETTERS(core[-1:]) else ""


def _unbroken(piece: str) -> bool:
    return piece.split() == [piece]


class PieceCache:
    """What ``values_of(ids, begins, ends)`` makes of each piece's ids; two generations, so that memory is bounded and frequent pieces stay.

    ``add`` joins the values of neighbouring pre-tokens: a new word with a comma is known if the word is.
    """

    def __init__(self, tokenizer, values_of: Callable[[np.ndarray, list[int], list[int]], list],
                 add: Callable[[object, object], object], prefix: str = "", border: str = "",
                 generation: int = GENERATION, core: Callable[[str], str] = _core,
                 plain: Callable[[str], bool] = str.isalpha, of_letters=None):
        """``border``: how tokens begin (with ``prefix``) or else end where one plain word meets the next.

        ``core`` cuts off what is a pre-token of its own; ``of_letters``: a tokenizer that encodes words of ``LETTERS`` alike.
        """
        self.core, self.plain, self.of_letters = core, plain, of_letters
        self.tokenizer, self.values_of, self.add, self.prefix = tokenizer, values_of, add, prefix
        self.generation = generation
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.bounds = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.bounds[i] = bool(border) and (token.startswith(border) if prefix else token.endswith(border))
        added = json.loads(tokenizer.to_str())["added_tokens"]
        self.specials = [t["content"] for t in added]
        self.parting, self.parting_id = (added[0]["content"], added[0]["id"]) if added else (None, None)
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.tails = {t: self.value(tokenizer.encode(t, add_special_tokens=False).ids) for t in TAILS}

    def value(self, ids: list[int]):
        return self.values_of(np.array(ids, np.int64), [0], [len(ids)])[0]

    def values(self, pieces: list[str]) -> list:
        found = list(map(self.young.get, pieces))
        if None in found:
            gaps = [i for i, v in enumerate(found) if v is None]
            fresh = self._fill({pieces[i] for i in gaps})
            for i in gaps:
                found[i] = fresh[pieces[i]]
        return found

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def _fill(self, pieces: set[str]) -> dict[str, object]:
        before = list(map(self.old.get, pieces)) if self.old else []
        out = {p: v for p, v in zip(pieces, before) if v is not None}
        new = [p for p in pieces if p not in out] if out else list(pieces)
        letters: list[str] = []
        words: list[str] = []
        others: list[str] = []
        tailed: list[str] = []
        cores: list[str] = []
        for p in new:
            if self.of_letters is not None and LETTERS(p):
                letters.append(p)
            elif core := self.core(p):
                tailed.append(p)
                cores.append(core)
            else:
                (words if self.plain(p) else others).append(p)
        for p, core, value in zip(tailed, cores, self.values(cores) if cores else []):
            out[p] = self.add(value, self._tail(p[len(core):]))
        for kind, encode in ((letters, self._letters), (words, self._words), (others, self._encode)):
            for start in range(0, len(kind), CALL):
                part = kind[start:start + CALL]
                out.update(zip(part, encode(part)))
        self.young.update(out)
        for p in [p for p in new if len(p) > PIECE]:
            self.young.pop(p, None)
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}
        return out

    def _tail(self, tail: str):
        if tail not in self.tails:
            self.tails[tail] = self.value(self.tokenizer.encode(tail, add_special_tokens=False).ids)
        return self.tails[tail]

    def _letters(self, words: list[str]) -> list:
        return self._words(words, self.of_letters)

    def _words(self, words: list[str], tokenizer=None) -> list:
        """Values of plain words, encoded as texts of many words and parted where tokens begin or end a word."""
        parts = [words[s:s + TEXT] for s in range(0, len(words), TEXT)]
        texts = [self.prefix + (self.prefix or " ").join(part) for part in parts]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in (tokenizer or self.tokenizer).encode_batch_fast(
            texts, add_special_tokens=False)])
        cuts = np.flatnonzero(self.bounds[ids])
        if len(cuts) != len(words):  # no such border, or letters that normalise to several words
            return self._encode(words)
        if self.prefix:
            return self.values_of(ids, cuts.tolist(), [*cuts[1:].tolist(), len(ids)])
        return self.values_of(ids, [0, *(cuts[:-1] + 1).tolist()], (cuts + 1).tolist())

    def _encode(self, pieces: list[str]) -> list:
        texts = [self.prefix + p for p in pieces]
        plain = self.parting is not None and not any(s in t for t in texts for s in self.specials)
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([self.parting.join(texts)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(ids == self.parting_id)
            if len(cuts) == len(texts) - 1:
                return self.values_of(ids, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])
        return [self.value(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _of_letters(tokenizer):
    """The same tokenizer where each word of letters, with the space before it, is one pre-token by its spaces alone."""
    from tokenizers import Tokenizer, pre_tokenizers

    same = Tokenizer.from_str(tokenizer.to_str())
    same.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return same


class TextEncoder:
    """Ids of whole texts as bytes of one unsigned type, for tokenizers that attach a space to the next word.

    Lines part at newlines between non-spaces, and lines at single spaces. Other runs of white space and
    special tokens bind over piece borders; such texts go to the library whole.
    """

    def __init__(self, tokenizer, dtype: np.dtype):
        self.tokenizer, self.dtype = tokenizer, dtype
        self.first = PieceCache(tokenizer, self._slices, bytes.__add__)
        self.inner = PieceCache(tokenizer, self._slices, bytes.__add__, prefix=" ", border="\u0120", generation=2 * GENERATION,
                                core=_core_of_run, plain=_unbroken, of_letters=_of_letters(tokenizer))
        self.newline = self._whole("\n")

    def _slices(self, ids: np.ndarray, begins: list[int], ends: list[int]) -> list[bytes]:
        packed, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        return [packed[b * width:e * width] for b, e in zip(begins, ends)]

    def _whole(self, text: str) -> bytes:
        return self.first.value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _lines(self, text: str) -> list[str] | None:
        if "  " in text or any(s in text for s in self.first.specials):
            return None
        lines = text.split("\n")
        if len(lines) > 1 and not all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            return [text]
        return lines

    def encode_joined(self, texts: list[str], end: bytes) -> tuple[pa.Buffer, np.ndarray]:
        """The ids of all texts one behind the other, each with ``end`` behind it, and the number of ids of each.

        Arrow splits the lines and numbers their pieces; Python sees each distinct piece once, and the
        ids are put together by taking the values of the numbers.
        """
        split = [self._lines(t) for t in texts]
        n_lines = np.array([len(x) if x else 1 for x in split], np.int64)
        last = np.cumsum(n_lines) - 1
        whole = np.array([x is None for x in split], bool)
        pieces = pc.split_pattern(pa.array([x for lines in split for x in lines or ("",)], pa.large_string()), " ")
        offsets = pieces.offsets.to_numpy()
        numbered = pieces.values.dictionary_encode()
        codes, words = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary.to_numpy(zero_copy_only=False)
        heads = offsets[:-1]
        is_inner = np.ones(len(codes), bool)
        is_inner[heads] = False
        used = np.zeros(len(words), bool)
        used[codes[is_inner]] = True
        values = self.inner.values(words[used].tolist())
        head_words, head_of = np.unique(codes[heads], return_inverse=True)
        first = len(values)
        values += self.first.values(words[head_words].tolist())
        newline = len(values)
        values += [self.newline, end, *(self._whole(t) for t, w in zip(texts, whole.tolist()) if w)]

        codes = (np.cumsum(used) - 1)[codes]
        codes[heads] = first + head_of
        codes[heads[last[whole]]] = newline + 2 + np.arange(whole.sum())
        behind = offsets[1:] + np.arange(len(heads))  # the places of what follows each line
        row = np.full(len(codes) + len(heads), newline, np.int64)
        is_piece = np.ones(len(row), bool)
        is_piece[behind] = False
        row[is_piece] = codes
        row[behind[last]] = newline + 1
        ids = pa.array(values, pa.large_binary()).take(pa.array(row))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[behind[last] + 1] // self.dtype.itemsize
        return ids.buffers()[2], np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def text_encoder(path: str, end_id: int) -> tuple[TextEncoder, np.dtype]:
    """The encoder of this worker process, with what it has cached in earlier tasks, and the type of its ids."""
    tokenizer = load_tokenizer(path)
    large = max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) > 1 << 16
    dtype = np.dtype("<u4" if large else "<u2")
    return TextEncoder(tokenizer, dtype), dtype
