import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tickscope.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(decontaminate.ascii_uppercase, decontaminate.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i:i + n]), set()).add(item or "")
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for gram, ids in grams.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i:i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found |= ids
        spans, run = [], sorted(hit)
        for p in run:
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((doc_id, len(w), [tuple(s) for s in spans], sorted(found)))
    return out


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id string, text string, pos string, n int")


def corpus(messy):
    rng = random.Random(11)
    vocabulary = ["a", "B", "Ünï", "x1", "İd", "7", "end", "the"]
    bench = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 9])))) for k in range(12)]
    bench += [("i1", None), ("i2", ""), (None, "one null id"), ("i9", "one NULL id"), ("i3", "twice " * 300)]
    docs = [(k + 50, " ".join(rng.choice(["%s", "%s.", "(%s)", "%s,\n"]) % rng.choice([*vocabulary, *(f"own{j}" for j in range(40))])
                              for _ in range(rng.randint(0, 60)))) for k in range(40)]
    docs += [(99, "said ONE, null id twice twice twice twice; over"), (99, "said ONE, null id twice twice twice twice; over"),
             (98, "begins " + bench[0][1]), (97, "twice " * 700)]
    return docs + messy, bench


@pytest.mark.parametrize("window,block,parts", [(4, 256, 400_000), (4, 3, 5), (1, 2, 400_000)])
def test_equal_to_brute_force(documents, items, messy, window, block, parts, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "PART_ROWS", parts)
    docs, bench = corpus(messy if block > 100 else [m for m in messy if len(m[1] or "") < 1000])
    got = decontaminate.contamination(documents(docs).repartition(3), items(bench), window).collect()
    ours = sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.items) for r in got), key=repr)
    assert ours == sorted(brute(docs, bench, window), key=repr)


def test_query_equals_its_sql(spark, documents, items, messy, tmp_path):
    docs = [(k, t) for k, (_, t) in enumerate(corpus(messy)[0]) if len(t or "") < 10_000]  # the SQL grows with the square
    bench = [(i, t) for i, t in corpus(messy)[1] if i] + [("long", " ".join(f"w{k}" for k in range(30)))]
    docs.append((500, "Begin: " + " ".join(f"W{k}" for k in range(5, 30)) + " the end"))
    documents(docs).write.parquet(f"{tmp_path}/documents.parquet")
    items(bench).write.parquet(f"{tmp_path}/benchmark.parquet")
    ours = queries.QUERIES["op11_benchmark_leaks"](spark, str(tmp_path))
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert sorted(map(tuple, ours.collect())) == sorted(con.sql(f"SELECT {', '.join(ours.columns)} FROM ({queries.LEAK_SQL})").fetchall())


def test_removal(documents, items, messy):
    docs, bench = corpus(messy)
    expected = brute(docs, bench, 4)
    table, tests = documents(docs).withColumn("key", F.lit("own")).withColumn("spans", F.lit(7)), items(bench)
    kept = decontaminate.without_documents(table, tests, window=4)
    assert kept.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id and r.text) == sorted(
        d for d, e in zip(docs, expected) if not e[2] and d[0] and d[1])
    cut = decontaminate.without_spans(table, tests, window=4)
    assert cut.columns == table.columns
    wanted = []
    for (doc_id, text), (_, _, spans, _) in zip(docs, expected):
        places = [m.span() for m in WORD.finditer((text or "").translate(LOWER))]
        for start, end in reversed(spans):
            text = text[:places[start][0]] + text[places[end - 1][1]:]
        wanted.append((doc_id, text, "own", 7))
    assert sorted(((r.doc_id, r.text, r.key, r.spans) for r in cut.collect()), key=repr) == sorted(wanted, key=repr)


def test_empty_tables(documents, items):
    assert decontaminate.contamination(documents([]), items([("a", "some words")])).collect() == []
    row = decontaminate.contamination(documents([(1, "some words")]), items([])).first()
    assert (row.n_words, row.spans, row["items"]) == (2, [], [])


def test_no_shuffle_of_texts(documents, items):
    plan = decontaminate.contamination(documents([(1, "some words")]), items([("a", "some words")]))
    assert "Python" not in plan._jdf.queryExecution().toString() and "MapInArrow" not in plan._jdf.queryExecution().toString()
