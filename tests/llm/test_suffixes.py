import numpy as np
import pytest

from tickscope.llm import suffixes


def made(length, n_texts=40):
    rng = np.random.default_rng(length)
    texts = [rng.integers(97, 100, int(n), dtype=np.uint8).tobytes() for n in rng.integers(0, 500, n_texts)]
    texts += [texts[3] + texts[4], b"z" * 700]
    skipped = np.arange(len(texts)) % 9 == 5
    return suffixes.Chunk(b"".join(texts), np.array([len(t) for t in texts], np.int64), skipped, length)


@pytest.mark.parametrize("length", [1, 3, 20, 100])
def test_blocks_change_no_hash_sample_or_candidate(length, monkeypatch):
    whole = made(length)
    hashes = whole.hashes.of(length)
    of_bytes = {}
    for s in range(len(hashes)):  # equal hashes are those of equal strings
        assert of_bytes.setdefault(whole.data[s:s + length].tobytes(), hashes[s]) == hashes[s]
    assert len(set(of_bytes.values())) == len(of_bytes)
    repeated = np.unique(whole.samples[1])[::2]
    starts, names = whole.candidates(repeated)
    assert len(starts) and np.array_equal(names, hashes[starts]) and whole.valid[starts].all()
    monkeypatch.setattr(suffixes, "BLOCK", 64)
    cut = made(length)
    assert np.array_equal(cut.hashes.of(length), hashes)
    for a, b in zip([*whole.samples, starts, names], [*cut.samples, *cut.candidates(repeated)]):
        assert np.array_equal(a, b)


def test_k_grams_of_a_chunk_are_hashed_once(monkeypatch):
    """Each of the passes over a chunk hashed and compared all its k-grams again, up to three times."""
    passes = []
    of = suffixes.Hashes.of
    monkeypatch.setattr(suffixes.Hashes, "of", lambda self, n, starts=None: (starts is None and passes.append(n), of(self, n, starts))[1])
    chunk = made(100)
    hashes = suffixes._sampled(chunk)
    starts, _ = chunk.candidates(hashes[::2])
    assert len(starts) and passes == [chunk.k]


def test_names_are_numbered_by_their_first_places():
    names = np.array([7, 1 << 63, 7, 5, 1 << 63, 9], np.uint64)
    distinct, codes, first = suffixes._distinct(names)
    assert distinct.tolist() == [7, 1 << 63, 5, 9] and codes.tolist() == [0, 1, 0, 2, 1, 3]
    assert first.tolist() == [True, True, False, True, False, True]
    assert [len(x) for x in suffixes._distinct(names[:0])] == [0, 0, 0]
