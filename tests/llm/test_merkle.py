import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from tickscope.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, item long, rank long, block long"


def h(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """All levels, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h("".join(row[k:k + 8])) for k in range(0, len(row), 8)])
    return levels


def path(levels, i):
    for row in levels[:-1]:
        run = row[i // 8 * 8:i // 8 * 8 + 8]
        yield "".join(run[:i % 8]), "".join(run[i % 8 + 1:])
        i //= 8


def brute(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    leaf = lambda r, text: h("".join(map(field, (*r[:4], text))))
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        ordered = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[lang] = ordered, tree([leaf(r, r[4]) for r in ordered])
    top = tree([trees[x][1][-1][0] for x in langs])
    out = []
    for place, lang in enumerate(langs):
        ordered, levels = trees[lang]
        for i, r in enumerate(ordered):
            steps = [*path(levels, i), *path(top, place)]
            picked = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, r[4].translate(lower) if picked and r[4] is not None else r[4])
            for before, after in steps:
                node = h(before + node + after)
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], h("".join(b + a for b, a in steps)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(seed, n, langs):
    rng = random.Random(seed)
    return [(k * 3, rng.choice(["a", "b", None]), rng.choice(langs), rng.choice([None, k]), rng.choice(["", None, f"Text {k} É", "plain"]))
            for k in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "own", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n,langs,height", [(700, ["en"] * 20 + ["de", None, "ü", "-", ""], 1), (700, ["en"] * 9 + ["de", None], 2),
                                            (200, [f"l{k}" for k in range(90)], 4), (1, ["x"], 4), (8, ["x"], 1), (65, ["x"], 2)])
def test_equal_to_brute_force(spark, n, langs, height):
    rows = rows_of(n, n, langs)
    got = merkle.proofs(merkle.build_manifest(table(spark, rows), height=height)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_messy_rows(spark, messy):
    rows = [(i, None if k % 4 else "s", None if k % 3 else "en", None, t) for k, (i, t) in enumerate(messy)]
    got = merkle.proofs(merkle.build_manifest(table(spark, rows), height=1)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert merkle.proofs(merkle.build_manifest(table(spark, []))).collect() == []


def test_query_equals_its_sql(spark, tmp_path):
    table(spark, rows_of(5, 300, ["en", "en", "de", None])).write.parquet(f"{tmp_path}/documents.parquet")
    ours = queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, ours.collect())) == sorted(con.sql(f"SELECT {', '.join(ours.columns)} FROM ({queries.MERKLE_SQL})").fetchall())


@pytest.mark.parametrize("levels", range(1, 6))
def test_van_emde_boas_order(levels):
    at = merkle.places(levels)
    assert sorted(int(p) for depth in at for p in depth) == list(range(merkle.n_nodes(levels)))
    top = levels // 2
    if top:  # the top part is one stretch, and so is each bottom part
        assert max(int(p) for depth in at[:top] for p in depth) == merkle.n_nodes(top) - 1
        size = merkle.n_nodes(levels - top)
        for j in range(8**top):
            mine = [int(p) for r, depth in enumerate(at[top:]) for p in depth[j * 8**r:(j + 1) * 8**r]]
            assert min(mine) == merkle.n_nodes(top) + j * size and max(mine) == min(mine) + size - 1
