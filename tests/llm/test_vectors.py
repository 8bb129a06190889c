import math

import numpy as np

from tickscope.llm import ann, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n long, cid long, space string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "s") for r in rows], SCHEMA)


def clusters(rng, n, groups, dims=16):
    centres = rng.standard_normal((groups, dims))
    return [(int(k), (centres[k % groups] + rng.standard_normal(dims) * rng.choice([0.0, 0.02, 0.08, 0.5])).astype(np.float32).tolist(),
             int(k % 3)) for k in range(n)]


ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [math.nan] * 16, 1), (903, [1.0] * 16, None), (904, [1.0] * 16, 1),
       (905, [2.0] * 16, 1), (905, [2.0] * 16, 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (908, [1.0, None, 3.0], 1),
       (909, [], 1), (910, [1e-38] * 16, 1), (911, [3e38] * 16, 2), (None, [-1.0] * 16, 0), (912, [math.inf] + [0.0] * 15, 0)]


def fit(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def brute(rows, threshold):
    n = len(rows)
    near = [[j for j in range(n) if i != j and fit(rows[i][1]) and fit(rows[j][1]) and rows[i][2] is not None
             and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold]
            for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(n)]
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids) if ids else None))
    return out


def by_value(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def test_links_equal_brute_force(spark, monkeypatch):
    rows = clusters(np.random.default_rng(1), 160, 12) + ODD
    for tile in (1024, 7):
        monkeypatch.setattr(vectors, "TILE", tile)
        got = vectors.near_vectors(frame(spark, rows)).collect()
        assert by_value((r.vec_id, r.n_links, r.component_id) for r in got) == by_value(brute(rows, 0.98))
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_vectors(frame(spark, [])).collect() == []


def test_error_bounds_hold():
    rng = np.random.default_rng(3)
    x, norm = vectors.unit(rng.standard_normal((300, 40)) * rng.choice([1e-200, 1.0, 1e200], (300, 1)))
    codes, scale, size, error = vectors.quantised(x, norm)
    exact = (x / norm[:, None]) @ (x / norm[:, None]).T
    near = vectors.code_products(codes, codes) * scale[:, None] * scale
    bound = size[:, None] * error + error[:, None] * (size + error)
    assert (np.abs(exact - near) <= bound).all() and bound.max() < 0.1


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i + 10_000, v, k) for i, v, k in clusters(rng, 3000, 150)] + [(4000 + k, [1.0] * 16, 0) for k in range(40)] + [
        r for r in ODD if r[0] not in (908,)]
    base = frame(spark, rows)
    got = {}
    for r in ann.nearest(base, base.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = total = 0
    for q, v, _ in rows:
        if q is None or q % 50 or not fit(v):
            assert q not in got
            continue
        others = [(-cosine(v, w), i) for i, w, _ in rows if i is not None and i != q and fit(w) and len(w) == len(v)]
        best = sorted(others)[:5]
        ours = sorted(got.get(q, []))
        assert [r for r, _, _ in ours] == list(range(1, len(best) + 1))
        assert ours == sorted(ours, key=lambda r: (-r[2], r[1]))
        table = {i: -c for c, i in others}
        assert all(abs(table[i] - s) < 1e-12 for _, i, s in ours)
        total += len(best)
        found += sum(s >= -best[-1][0] - 1e-12 for _, _, s in ours)
    assert total and found / total >= 0.9


def test_ties_and_small_tables(spark):
    rows = [(k, [1.0, 0.0], 0) for k in range(8)]
    base = frame(spark, rows)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(base, base.where("vec_id in (0, 3)")).collect())
    assert got == [(0, k, k) for k in range(1, 6)] + [(3, 1, 0), (3, 2, 1), (3, 3, 2), (3, 4, 4), (3, 5, 5)]
    assert ann.nearest(frame(spark, []), frame(spark, [])).collect() == []
    assert ann.nearest(frame(spark, rows[:1]), frame(spark, rows[:1])).collect() == []


def test_isolated_queries_get_k_rows(spark):
    """Tight clusters set the probes to one list; isolated queries and shared ids must still get all their rows."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((60, 16))
    rows = [(1000 + k, (centres[k % 60] + 0.001 * rng.standard_normal(16)).tolist(), 0) for k in range(5880)]
    rows += [(k, (5 * rng.standard_normal(16)).tolist(), 0) for k in range(120)]
    rows += [(500, centres[7].tolist(), 0)] * 300
    base = frame(spark, rows)
    sample = np.array([r[1] for r in rows])
    index = ann.fit_index(sample, len(rows), 5, 0.97)
    sizes = np.bincount((vectors.unit(sample)[0] @ index.centres.T).argmax(axis=1), minlength=len(index.centres))
    assert index.probes == 1 and (sizes < 6).any()
    got = {}
    for r in ann.nearest(base, base.where("vec_id < 120 or vec_id = 500").dropDuplicates(["vec_id"])).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {*range(120), 500}
    assert all(len(v) == 5 and q not in v for q, v in got.items())
