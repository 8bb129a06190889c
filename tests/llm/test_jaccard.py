import random
import re

import numpy as np

from tickscope.llm import jaccard
from tickscope.llm.components import components
from tickscope.llm.shingles import shingle_set


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc_id, n_links, component_id, kept) of each row; rows with equal ids are told apart by place."""
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j]
              and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
    out = []
    for i in range(n):
        group = [j for j in range(n) if root[j] == root[i]]
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return out


def near_copies(rng, n, base):
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


def check(documents, rows, **sizes):
    got = jaccard.jaccard_links(documents(rows)).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    kept = {}
    for r in got:
        if r.n_links:
            kept[r.component_id] = kept.get(r.component_id, 0) + r.kept
        else:
            assert r.kept
    assert all(n == 1 for n in kept.values())
    return got


def test_links_and_components_equal_brute_force(documents, messy):
    rng = random.Random(3)
    rows = list(messy)
    for g in range(6):
        base = [f"w{g}_{rng.randrange(60)}" for _ in range(rng.choice([6, 40, 120]))]
        rows += [(100 * (g + 1) + k, t) for k, t in enumerate(near_copies(rng, 12, base))]
    rng.shuffle(rows)
    check(documents, rows)


def test_large_groups_are_cut_into_blocks(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rng = random.Random(8)
    base = [f"v{rng.randrange(500)}" for _ in range(90)]
    rows = [(k, t) for k, t in enumerate(near_copies(rng, 40, base))] + [(50, "alone in the world of many words")]
    check(documents, rows)


def test_one_row_of_each_group_stays(documents, messy):
    docs = documents(messy)
    left = jaccard.without_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left.collect())
    texts = [t for _, _, t in ids]
    assert texts.count("x") == 1 and texts.count("same words in the same order again") == 1 and texts.count("") == 4
    assert len(ids) == len(messy) - 2
    assert jaccard.jaccard_links(documents([])).collect() == []
    assert jaccard.without_near_duplicates(documents([])).collect() == []


def test_shingles_are_distinct_as_words_are():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 80)))
        assert len(shingle_set(text)) == len(grams(text))


def test_both_ways_to_intersect_agree():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(30)]
    i, j = np.nonzero(np.tri(30, k=-1, dtype=bool).T)
    many = jaccard.intersections(sets, i, j)
    few = np.concatenate([jaccard.intersections(sets, i[s:s + 50], j[s:s + 50]) for s in range(0, len(i), 50)])
    assert (many == few).all()


def test_posterior_bounds():
    fewest = jaccard.least_matches(0.8)
    assert list(fewest) == sorted(fewest) and all(m <= 0.8 * 32 * (k + 1) for k, m in enumerate(fewest))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(60)] + [(200, k) for k in range(201, 260)] + [(500, 501), (501, 500), (7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(200, 260), 200), 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
