import math

import numpy as np
import pytest

from tickscope.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, index long, d string, n long, file string, place int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 5, "own", 6, "f", 7) for i, v in rows], SCHEMA).repartition(3)


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    return [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(rng.normal(size=(n, d)) @ mix + 3)]


@pytest.mark.parametrize("n,d", [(600, 40), (300, 5), (64, 2)])
def test_equal_to_brute_force(spark, n, d, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_CELLS", 7 * d)  # many row blocks, a ragged last one
    monkeypatch.setattr(whitening, "SPLIT_BLOCKS", 3)
    rows = vectors(n, n, d)
    got = {r.vec_id: r for r in whitening.whiten(table(spark, rows)).collect()}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(column) for column in zip(*x)]
    exact = np.array([[n * a - s for a, s in zip(r, sums)] for r in x], float) / n
    covariance = exact.T @ exact / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    expected = exact @ axes / np.sqrt(values)
    ours = np.array([got[k].whitened for k in range(n)])
    assert ours.shape == (n, min(d, 32))
    signs = np.sign((ours * expected).sum(axis=0))
    assert np.allclose(ours * signs, expected, atol=1e-8)
    assert [got[k].deviation for k in range(n)] == [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    assert np.allclose(got[0].explained, values / np.trace(covariance), rtol=1e-9)
    assert len({(r.n, r.identity_error, tuple(r.explained)) for r in got.values()}) == 1
    assert got[0].n == n and got[0].identity_error < 1e-8
    centred = ours - ours.mean(axis=0)
    assert got[0].identity_error == pytest.approx(np.abs(centred.T @ centred / n - np.eye(ours.shape[1])).max(), abs=1e-10)


def test_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [0.5, -2.0]), (7, [0.0, 0.0])]
    bad = [(3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (8, [inf, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [1e30, 0.0])]
    got = whitening.whiten(table(spark, good + bad)).collect()
    assert sorted(repr(r.vec_id) for r in got) == sorted(repr(i) for i, _ in good)
    assert {r.n for r in got} == {5} and len({tuple(r.whitened) for r in got if r.vec_id == 2}) == 1
    assert whitening.whiten(table(spark, [])).collect() == [] and whitening.whiten(table(spark, bad[:5])).collect() == []


def test_large_entries_and_no_variance(spark):
    big = 2.0**40
    got = whitening.whiten(table(spark, [(k, [big * (k % 2), 1.0, float(k)]) for k in range(40)])).collect()
    assert all(r.deviation is None for r in got) and all(r.whitened[2] is None for r in got)  # the second entry never varies
    assert got[0].identity_error < 1e-4 and got[0].explained[2] == 0
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, [None, None], [0.0, 0.0], 0.0)]


def test_query(spark, tmp_path):
    table(spark, vectors(3, 90, 36)).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.QUERIES["op13_whitening"](spark, str(tmp_path)).collect()
    assert len(rows) == 90 * 32 and {r.component for r in rows} == set(range(1, 33))
