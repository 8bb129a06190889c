import duckdb
import pytest

from tickscope.llm import mixing, queries

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.MIX_SQL})").fetchall()


def key(row):
    return tuple((v is None, v or 0) for v in row)


def same(ours, theirs):
    ours, theirs = sorted(ours, key=key), sorted(theirs, key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert tuple(a) == pytest.approx(tuple(b), nan_ok=True) if None not in a else tuple(a) == tuple(b)


def test_targets_and_thresholds_agree_with_sql(spark, documents):
    rows = [(k, " ".join(["w"] * (k % 37)), f"s{k % 5}" if k % 3 else "hot") for k in range(900)]
    mixed = mixing.mix_sources(documents(rows)).select(*COLUMNS).collect()
    same(mixed, oracle(rows))
    targets, taken = {}, {}
    for r in mixed:
        targets[r.source_size] = r.target
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert all(abs(taken[s] - t) <= 37 for s, t in targets.items())
    assert all(r.taken <= 2 * r.size for r in mixed)


def test_messy_rows(documents, messy):
    rows = [(i, t, s) for (i, t), s in zip(messy, ["b", None, "a", "é", None, "a", "a", "b", "b", "c", "c", None, "z"])]
    mixed = mixing.mix_sources(documents(rows))
    same(mixed.select(*COLUMNS).collect(), oracle(rows))
    assert mixed.where("size = 0 and taken <> 0").count() == 0


def test_a_larger_budget_only_adds(documents):
    rows = [(k, " ".join(["w"] * (1 + k % 9)), "ab"[k % 2]) for k in range(300)]
    few = {r.doc_id: r.copies for r in mixing.mix_sources(documents(rows), share=0.4).collect()}
    more = {r.doc_id: r.copies for r in mixing.mix_sources(documents(rows), share=0.7).collect()}
    assert all(few[k] <= more[k] for k in few) and sum(few.values()) < sum(more.values())


def test_rows_of_the_mix(documents, messy):
    docs = documents([(k, " ".join(["w"] * (1 + k % 9)), "abc"[k % 3]) for k in range(200)])
    wanted = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    got = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert got == {k: c for k, c in wanted.items() if c}
    assert mixing.mixed_rows(documents(messy)).count() > 0


def test_empty_table(documents):
    assert mixing.mix_sources(documents([])).collect() == []
    assert mixing.mixed_rows(documents([])).collect() == []
