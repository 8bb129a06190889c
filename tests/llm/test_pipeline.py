import random
from collections import Counter

import duckdb

import corpus_pipeline
from tickscope.llm import jaccard, mixing, queries, secrets, toxicity
from tickscope.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = (text or "").encode().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def corpus(rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows, labels = [], []
    for k in range(260):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if k % 9 == 0:
            for _ in range(5):
                text.insert(rng.randrange(20), rng.choice(["idiot", "moron", "scum"]))
        if k % 7 == 0:
            text.insert(3, "password = " + "".join(rng.choice("0123456789abcdef") for _ in range(20)))
        rows.append((k, " ".join(text), "en", f"src{k % 3}" if k % 11 else None, 1))
        labels.append((k, 1, int(k % 9 == 0)))
    for k in range(30):  # near copies of clean documents
        text = rows[9 * k % 250 + 1][1].split()
        text[rng.randrange(len(text))] = "edited"
        rows.append((1000 + k, " ".join(text + ["more"]), "en", "src1", 1))
    rows += [(2000, None, None, None, None), (2001, "", "en", "src0", 0), (None, "a text without an id is kept", "en", "src0", 5)]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus(random.Random(5))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf_dir, docs, seen = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "bpe_encoding" or docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        seen.append(sorted(map(tuple, docs.select("doc_id", "text", "source", "n_chars").collect()) if name != "bpe_encoding" else
                           [(r.doc_id, r.ids) for r in docs.collect()], key=repr))
    clean, single, redacted, mixed, encoded = seen

    # toxicity: the planted documents go, the others stay
    source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(source, spark.read.parquet(str(tmp_path / "labels.parquet")))
    scorer = toxicity.Scorer(model)
    assert clean == sorted(((i, t, s, n) for i, t, _, s, n in rows if scorer.score(t or "") < toxicity.THRESHOLD), key=repr)
    assert not any("idiot" in (t or "") for _, t, _, _ in clean)

    # near-duplicates: no two that are left are linked, and one of each linked pair is left
    sets = {i: grams(t) for i, t, _, _ in clean}
    left = {i for i, _, _, _ in single}
    near = [(a, b) for a in sets for b in sets if a is not None and b is not None and a < b and sets[a] and sets[b]
            and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert near and not any(a in left and b in left for a, b in near)
    assert left == set(sets) - {b for _, b in near}

    # secrets: all rows stay, with the kinds in place of the secrets
    def replaced(text):
        if text is None:
            return None
        return secrets._replace(text, secrets.Scanner(secrets.BASE_RULES + secrets.MORE_RULES).spans([text])[0],
                                secrets.BASE_RULES + secrets.MORE_RULES)

    assert redacted == sorted(((i, r, s, n if r == t else len(r)) for i, t, s, n in single for r in [replaced(t)]), key=repr)
    assert any("[assign]" in (t or "") for _, t, _, _ in redacted)

    # mixing: rows repeat as the SQL twin says
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in redacted])
    taken = con.execute(f"SELECT doc_id, size, taken FROM ({queries.MIX_SQL})").fetchall()
    counts = Counter(i for i, _, _, _ in mixed)
    assert all(counts[i] == t // s for i, s, t in taken if s)

    # encoding: as the library does
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    wanted = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, _, _ in mixed]
    assert encoded == sorted(wanted, key=repr)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(encoded)


def test_an_empty_corpus_passes_through(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_columns_with_names_of_their_own(spark):
    names = ["__key", "__h", "__times", "__edge", "__source", "__copy", "of", "of_id", "doc", "blank", "pick", "copy", "copies", "edge",
             "times", "with_edge", "stays", "key", "h", "size", "cls", "sid", "prefix"]
    rows = [(k, f"some words of text number {k % 3} that go on for a while", "en", "ab"[k % 2], 10, *range(len(names))) for k in range(9)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long",
                                                  *(f"{n} long" for n in names)]))
    kept = jaccard.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[:3])
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(rows) and mixed.count() > 0
