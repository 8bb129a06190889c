import random
import re

import pytest

from tickscope.llm import suffixes, units


def removed_bytes(rows, length):
    """Per row, in the order of ids (null last, then place): its bytes and which of them go."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            piece = data[s:s + length]
            if piece in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(piece)
        out.append((doc_id, data, bytes(gone)))
    return out


def repeated_rows(rng, length):
    shared = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(length // 2, 4 * length))) for _ in range(5)]
    rows = []
    for k in range(60):
        own = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 3 * length)))
        rows.append((k, own + rng.choice(shared) + (rng.choice(shared) if k % 4 else "") + own[: rng.randint(0, 30)]))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "z" * 5 * length), (103, "z" * 2 * length), (104, "xy" * 3 * length)]
    return rows


@pytest.mark.parametrize("length,chunk", [(100, 1 << 20), (20, 500), (7, 200)])
def test_bytes_equal_brute_force(documents, length, chunk):
    rng = random.Random(length)
    rows = repeated_rows(rng, length)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = {r.doc_id: r for r in suffixes.remove_repeats(documents(shuffled).repartition(3), length, chunk).collect()}
    for doc_id, data, gone in removed_bytes(rows, length):
        row = got[doc_id]
        assert row.n_bytes == len(data)
        assert bytes(row.kept) == bytes(b for b, g in zip(data, gone) if not g)
        marked = bytearray(len(data))
        for s in row.spans:
            assert not any(marked[max(0, s.start - 1):s.end + 1])  # runs are maximal
            marked[s.start:s.end] = b"\1" * (s.end - s.start)
        assert bytes(marked) == gone


def test_messy_rows_lose_each_string_but_once(documents, messy):
    got = suffixes.remove_repeats(documents(messy), 10).collect()
    assert len(got) == len(messy)
    total = sum(r.n_bytes - len(r.kept) for r in got)
    assert total == sum(sum(g) for _, _, g in removed_bytes(messy, 10))
    assert suffixes.remove_repeats(documents([]), 10).collect() == []


@pytest.mark.parametrize("cuts,min_words", [(units.LINES, 1), (units.PARAGRAPHS, 1), (units.CLAUSES, 1), (units.CLAUSES, 6), (units.LINES, 4)])
def test_units_equal_brute_force(documents, messy, cuts, min_words, monkeypatch):
    monkeypatch.setattr(units, "HELD", 20)
    rng = random.Random(9)
    lines = ["A line", "a  LINE ", "other one, here", "", "  ", "x", "é", "long " * 40, "Stop. and go", "stop.", "a b c, d e f; g."]
    rows = [*((k + 50, rng.choice(["\n", "\n\n", " "]).join(rng.choice(lines + [f"own {k} {j}"]) for j in range(rng.randint(0, 9)))) for k in range(60)),
            *(r for r in messy if r[0] is not None and r[0] != 5)]
    got = {r.doc_id: r for r in units.dedup_units(documents(rows).repartition(4), cuts, min_words).collect()}
    seen, removed_units = set(), 0
    for doc_id, text in sorted(rows):
        ends = [m.start() for m in re.finditer(cuts, text or "") if m.start()]
        borders = [0, *ends, len(text or "")]
        found = []  # start, end with what ends the unit, words, repeated
        for start, end in zip(borders, borders[1:]):
            plain = " ".join((text or "")[start:end].lower().split())
            if plain:
                found.append((start, end, len(plain.split(" ")), plain in seen))
                seen.add(plain)
        gone = [False] * len(found)
        for k in range(len(found)):
            low = high = k
            while low and found[low - 1][3]:
                low -= 1
            while high + 1 < len(found) and found[high + 1][3]:
                high += 1
            gone[k] = found[k][3] and sum(f[2] for f in found[low:high + 1]) >= min_words
        left = text
        for (start, end, _, _), g in reversed(list(zip(found, gone))):
            left = left[:start] + left[end:] if g else left
        row = got[doc_id]
        assert row.text == left and row.n_units == len(found)
        assert [(s.start, s.end) for s in row.removed] == [
            (s, s + len(text[s:e].rstrip(" \n"))) for (s, e, _, _), g in zip(found, gone) if g]
        removed_units += sum(gone)
    assert removed_units > 20


def test_equal_rows_decide_alike_and_nulls_rank_last(documents, messy):
    rows = [(None, "twice"), (4, "twice"), (9, "same\nsame"), (9, "same\nsame")]
    got = sorted((r.doc_id is None, r.text, len(r.removed)) for r in units.dedup_units(documents(rows), units.LINES, 1).collect())
    assert got == [(False, "same\n", 1), (False, "same\n", 1), (False, "twice", 0), (True, "", 1)]
    assert units.dedup_units(documents(messy)).count() == len(messy)
    assert units.dedup_units(documents([])).collect() == []


def test_a_passage_inside_a_line_goes_and_short_repeats_stay(documents):
    passage = "The first part of a long passage, copied whole from one text; it ends here with the last of its many words. "
    rows = [(1, "One text opens. " + passage + "And goes on."), (2, "Another begins differently. " + passage + "And goes on."), (3, "And goes on.")]
    got = {r.doc_id: r.text for r in units.dedup_units(documents(rows)).collect()}
    assert got == {1: rows[0][1], 2: "Another begins differently. ", 3: "And goes on."}
