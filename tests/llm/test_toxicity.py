import random
import zlib

from pyspark.sql import functions as F

from tickscope.llm import toxicity

LABELS = "doc_id long, toxic int, quality int, text string"


def score(text, signs=frozenset()):
    model = toxicity.Model({"idiot": 4.0, "scum": 4.0, "kill": 3.0, "grubl": 4.0}, {}, signs)
    return toxicity.Scorer(model).evidence(text)[0]


def test_isolated_words_do_not_score():
    assert score("an idiot") == score("kill") == score("they kill") == score("a calm text") == score("") == 0
    assert score("grubl") == 0 < score("grubl", frozenset({"grubl"})) == score("an idiot", frozenset({"idiot"}))


def test_patterns():
    assert score("you are an idiot") == score("idiot that you are") > score("he is a piece of scum") - 1e-9 > 0
    assert score("a piece of scum") > 0 and score("piece by piece it all went to scum") == 0
    assert score("I will kill you") == score("i will you kill") > score("i kill you") > 0
    assert score("you are x x x x x idiot") == score("idiot x x x x x you") == 0


def test_negation_and_reported_speech():
    assert 0 < score("you are not an idiot") < score("you are an idiot")
    assert 0 < score("i will not kill you") < score("i will kill you")
    assert 0 < score("somebody said you are an idiot") == score("you idiot he said") < score("you idiot")
    assert score("he said it. you idiot") == score("you idiot")  # reported speech ends with the clause
    assert score("you will be here. kill") == 0  # so does every pattern
    assert score("it is not true and by the way you are an idiot") == score("x is y true and by the way you are an idiot")


def one_after_another(symbols):
    """Each transducer over the whole clause before the next one; (symbol, factor) per token."""
    tape = [(s, 1.0) for s in symbols]
    for rule, state in toxicity.PARTS:
        written = []
        for symbol, weight in tape:
            state, out, factor = rule(state, symbol)
            written.append((out, weight * factor))
        tape = written
    return tape


def test_composition_is_the_same_as_one_after_the_other():
    kinds = [toxicity.INSULT, toxicity.THREAT, toxicity.SIGN, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.MODAL,
             toxicity.HEAD, toxicity.OTHER, toxicity.OTHER]
    machine, rng, seen = toxicity.grammar(), random.Random(0), set()
    for _ in range(600):
        clause = [rng.choice(kinds) for _ in range(rng.randint(0, 14))]
        state, tape = machine.start, []
        for symbol in clause:
            state, out, factor = machine.step(state, symbol)
            tape.append((out, factor))
        assert tape == one_after_another(clause)
        seen |= {out for out, _ in tape}
    assert {toxicity.HIT, toxicity.HELD, toxicity.LATE, toxicity.BACK} <= seen


def test_texts_score_as_their_clauses_do():
    """Whole texts against the transducers one after another, with weights applied by hand."""
    words = ["you", "idiot", "kill", "will", "not", "said", "piece", "of", "grubl", "x", "."]
    model, rng = toxicity.Model({"idiot": 4.0, "kill": 3.0, "grubl": 2.0}, {}, frozenset({"grubl"})), random.Random(1)
    scorer = toxicity.Scorer(model)
    for _ in range(300):
        tokens, wanted = [rng.choice(words) for _ in range(30)], []
        for clause in " ".join(tokens).split("."):
            total = held = 0.0
            known = clause.split()
            kinds = [toxicity.SIGN if w == "grubl" else toxicity.CLASS_OF.get(w, toxicity.OTHER) for w in known]
            for w, (out, factor) in zip(known, one_after_another(kinds)):
                if out == toxicity.HIT:
                    total += model.weights[w] * factor
                elif out == toxicity.HELD:
                    held = model.weights[w] * factor
                elif out == toxicity.LATE:
                    total += held * factor
                elif out == toxicity.BACK:
                    total *= factor
            if total:
                wanted.append(total)
        assert list(scorer.clauses(tokens)) == wanted


def corpus(n=400):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(n):
        toxic = int(k % 5 == 0)
        words = [f"w{rng.randrange(300)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(40)]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(40), "grubl" + rng.choice(["a", "ek", "ion", "u", "ar"]) + rng.choice("xyz"))
        rows.append((k, " ".join(words)))
        labels.append((k, toxic, 1, "clash"))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    docs, truth = documents(rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(docs, truth)
    scored = toxicity.score_documents(docs, model).join(truth.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id")))
    found = scored.collect()
    assert len(found) > 50 and sum((r.score >= 0.3) == r.toxic for r in found) / len(found) > 0.97
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and abs(left.count() - 320) < 12


def test_held_out_rows_teach_nothing(spark, documents):
    rows, labels = corpus()
    hidden = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    flipped = [(k, 1 - t if k in hidden else t, q, x) for k, t, q, x in labels]
    docs = documents(rows)
    assert toxicity.fit(docs, spark.createDataFrame(labels, LABELS)) == toxicity.fit(docs, spark.createDataFrame(flipped, LABELS))


def test_messy_rows(spark, documents, messy):
    odd = [(1, None, 1, "x"), (None, 1, 1, "x"), (5, 1, 1, "x"), (5, 0, 1, "x"), (6, 0, 0, "x"), (99, 1, 1, "x"), (7, 7, 1, "x")]
    for labels in (odd, []):
        model = toxicity.fit(documents(messy), spark.createDataFrame(labels, LABELS))
        scored = toxicity.score_documents(documents(messy), model).collect()
        assert len(scored) == len(messy) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score_documents(documents([]), model).collect() == []
    assert toxicity.fit(documents([]), spark.createDataFrame(odd, LABELS)).weights["idiot"] > 0
