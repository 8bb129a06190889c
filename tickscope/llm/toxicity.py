"""Toxicity by a weighted finite-state grammar over clauses, with weights learned from labels."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import bounded_batches, stored

SAMPLE = 4000  # labelled rows of each class, at most, from which weights are learned
STEMS = (4, 5, 6)  # word beginnings that can carry a weight
LEAST_CONTEXTS, LEAST_WEIGHT, MOST_WEIGHT = 3, 1.5, 6.0
DEVIATIONS = 1.64  # a form counts if its weight less so many standard errors reaches LEAST_WEIGHT
PRIOR = 2.5  # weight of a listed word that the labels say nothing about
THRESHOLD = 0.3

# Classes of tokens, the tape alphabet of the grammar.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
SIGN, MODAL, HEAD = "sign", "modal", "head"  # a word that labels have shown to be hostile; "will"; "piece (of)"
# Written by the transducers: a hostile word that a target precedes, a match, a word that waits for its target, its match, a damped clause.
AIMED, HIT, HELD, LATE, BACK = "aimed", "hit", "held", "late", "back"
WORDS = {
    INSULT: "idiot idiots stupid moron morons loser losers scum trash garbage pathetic worthless disgusting clown imbecile "
            "dumb filth vermin idiote stupide idiota estúpido estúpida basura dumm dummkopf abschaum",
    THREAT: "kill hurt destroy strangle stab töten umbringen tuer matar",
    TARGET: "you your yours yourself they them he him she her these those du dich dir ihr euch sie tu toi te vous ils "
            "elles tú ti usted ustedes ellos ellas",
    MODAL: "will gonna going shall should must i'll we'll werde werden wirst sollst vais va allons voy vamos debes",
    HEAD: "piece waste bag bunch pack load stück haufen tas montón",
    NEGATION: "not no never isn't aren't wasn't don't doesn't without nicht kein keine nie ne pas jamais nunca sin",
    REPORT: "said says called calls wrote quoted alleged reported claimed according sagte schrieb nannte laut dit disait "
            "selon dijo llamó según",
}
CLASS_OF = {w: kind for kind, words in WORDS.items() for w in words.split()}
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]")
ENDS = frozenset(".!?;\n")


class Transducer:
    """A weighted finite-state transducer, (state, symbol) -> (next state, symbol written, factor), by a rule over few
    states. Arcs are kept once they were taken."""

    def __init__(self, rule, start):
        self.rule, self.start, self.arcs = rule, start, {}

    def step(self, state, symbol):
        found = self.arcs.get((state, symbol))
        if found is None:
            found = self.arcs[state, symbol] = self.rule(state, symbol)
        return found

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: what this one writes is read by the other; factors multiply."""
        def rule(state, symbol):
            a, middle, wa = self.step(state[0], symbol)
            b, out, wb = other.step(state[1], middle)
            return (a, b), out, wa * wb

        return Transducer(rule, (self.start, other.start))


NEAR = 4  # tokens between the parts of a pattern, at most


def target(left: int, symbol):
    """Marks hostile words with a target in the tokens before them. The state counts the tokens the last target still covers."""
    if symbol == TARGET:
        return NEAR, TARGET, 1.0
    after = max(0, left - 1)
    return (after, (AIMED, symbol), 1.0) if left and symbol in (INSULT, THREAT, SIGN) else (after, symbol, 1.0)


def insult(state: tuple[int, int], symbol):
    """Matches "you ... idiot", "idiot ... you" and "piece of filth"; a word that labels have shown to be hostile matches alone.

    The state counts the tokens in which a target or a word may still complete a pattern: (waiting insult, head)."""
    waiting, head = (max(0, n - 1) for n in state)
    if symbol in ((AIMED, INSULT), (AIMED, SIGN)):
        return (0, 0), HIT, 1.5
    if symbol == SIGN:
        return (0, 0), HIT, 1.0
    if symbol == INSULT:
        return ((0, 0), HIT, 1.0) if state[1] else ((NEAR, 0), HELD, 1.0)
    if symbol == HEAD:
        return (waiting, 2), HEAD, 1.0
    if symbol == TARGET and state[0]:
        return (0, head), LATE, 1.5
    return (waiting, head), symbol, 1.0


def threat(state: tuple[int, int, bool], symbol):
    """Matches "will ... kill ... you", "will ... you ... kill" and, with less weight, "kill ... you".

    The state: tokens that a modal still covers, tokens in which a target completes the threat, whether a modal stood before it."""
    covered, waiting, announced = state
    after, wait = max(0, covered - 1), max(0, waiting - 1)
    if symbol == MODAL:
        return (NEAR, wait, announced), MODAL, 1.0
    if symbol == (AIMED, THREAT) and covered:
        return (after, 0, False), HIT, 1.5
    if symbol in (THREAT, (AIMED, THREAT)):
        return (after, NEAR, covered > 0), HELD, 1.0
    if symbol in (TARGET, LATE) and waiting:
        return (after, 0, False), LATE, 1.0 if symbol == LATE else 1.5 if announced else 0.75
    return (after, wait, announced), symbol, 1.0


def negation(left: int, symbol):
    """Damps matches and waiting words in the three tokens behind a negation."""
    if symbol == NEGATION:
        return 3, NEGATION, 1.0
    return max(0, left - 1), symbol, 0.25 if left and symbol in (HIT, HELD) else 1.0


def reported(other: bool, symbol):
    """Behind a verb of reporting, matches belong to somebody else for the rest of the clause; so do those before it."""
    if symbol == REPORT:
        return True, REPORT if other else BACK, 1.0 if other else 0.5
    return other, symbol, 0.5 if other and symbol in (HIT, HELD) else 1.0


PARTS = ((target, 0), (insult, (0, 0)), (threat, (0, 0, False)), (negation, 0), (reported, False))


def grammar() -> Transducer:
    """Target, insult, threat, negation and reported speech, composed in this order over the classes of a clause."""
    first, *others = (Transducer(rule, start) for rule, start in PARTS)
    for other in others:
        first = first.then(other)
    return first


@dataclass
class Model:
    """Weights of words and stems, the words that labels have shown to be hostile on their own (all stems are), and weights of
    a document's evidence (with an offset) in its log odds."""

    weights: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    signs: frozenset[str] = frozenset()
    line: tuple[float, ...] = (1.0, 1.0, 0.0, -4.0)


class Scorer:
    """Evidence of whole texts; the class and weight of each recent word are remembered."""

    KNOWN = 300_000

    def __init__(self, model: Model):
        self.model, self.machine, self.known = model, grammar(), {}

    def _entry(self, word: str) -> tuple[str, float] | None:
        """Class and weight of a word that the grammar reads, None for others."""
        kind, weight = CLASS_OF.get(word), self.model.weights.get(word, 0.0)
        if kind not in (None, INSULT, THREAT):
            return kind, 0.0
        shown = word in self.model.signs
        for n in STEMS:
            if len(word) > n and (stem := self.model.stems.get(word[:n], 0.0)) > 0:
                weight, shown = max(weight, stem), True
        if weight <= 0 or (kind is None and not shown):
            return None
        return SIGN if shown else kind, weight

    def clauses(self, tokens: list[str]) -> Iterator[float]:
        """The score of each clause in which a pattern matches."""
        if len(self.known) > self.KNOWN:
            self.known = {}
        known = self.known
        try:
            entries = [known[t] for t in tokens]
        except KeyError:
            for t in set(tokens):
                if t not in known:
                    known[t] = False if t in ENDS else self._entry(t)
            entries = [known[t] for t in tokens]
        if not any(e and e[1] for e in entries):
            return
        state, score, held = self.machine.start, 0.0, 0.0
        for entry in [*entries, False]:
            if entry is False:
                if score:
                    yield score
                state, score = self.machine.start, 0.0
                continue
            state, out, factor = self.machine.step(state, entry[0] if entry else OTHER)
            if out == HIT:
                score += entry[1] * factor
            elif out == HELD:
                held = entry[1] * factor
            elif out == LATE:  # the target of the last word that waited for one
                score += held * factor
            elif out == BACK:
                score *= factor

    def evidence(self, text: str) -> tuple[float, float, float]:
        """The sum of the clause scores, the highest one, and the length of the text, in which words of a
        learned stem also occur by chance; sum and length as logarithms."""
        tokens = TOKEN.findall(text.lower())
        scores = list(self.clauses(tokens))
        return math.log1p(sum(scores)), max(scores, default=0.0) / MOST_WEIGHT, math.log1p(len(tokens)) if scores else 0.0

    def score(self, text: str) -> float:
        odds = sum(w * x for w, x in zip(self.model.line, (*self.evidence(text), 1.0)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def held_out(doc_id) -> "F.Column":
    """The rows that are kept for evaluation: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (word or stem, word before it) of each sampled text."""
    for batch in batches:
        found: set[tuple] = set()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            before = ""
            for word in TOKEN.findall((text or "").lower()):
                if word in ENDS:
                    continue
                found.add((word, before, toxic))
                found.update((f"{word[:n]}-", before, toxic) for n in STEMS if len(word) > n)
                before = word
            if len(found) > 100_000:
                yield _context_rows(found)
                found = set()
        yield _context_rows(found)


def _context_rows(found: set[tuple]) -> pa.RecordBatch:
    forms, before, toxic = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(before, pa.string()), pa.array(toxic, pa.int32())],
                                      ["form", "before", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most ``sample`` labelled rows of each class, those with the smallest hashes of their
    ids, never from held-out rows.

    A form's weight is the log odds of the distinct words before it in toxic against other texts: copies
    of one toxic document add nothing, since they repeat its contexts. Forms need three contexts.
    Without usable labels the listed words keep their prior weight.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(
        F.col(id_col).alias("of")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("of"), "of").limit(sample) for k in (0, 1)]
    ids = stored(chosen[0].unionByName(chosen[1]))
    # At most 2 * sample narrow rows: the bound that allows a broadcast. Of rows with one id the least text counts, so reruns agree.
    texts = stored(docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("text")).join(F.broadcast(ids), "of")
                   .groupBy("of", "toxic").agg(F.min("text").alias("text")))
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = {w: PRIOR for w, kind in CLASS_OF.items() if kind in (INSULT, THREAT)}
    if len(sizes) < 2:
        return Model(known)
    forms = texts.mapInArrow(_contexts, "form string, before string, toxic int").distinct().groupBy("form").agg(
        F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    weight = F.log((F.col("pos") + 0.5) / (sizes[1] + 1)) - F.log((F.col("neg") + 0.5) / (sizes[0] + 1))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    weighed = forms.withColumn("sure", weight - DEVIATIONS * error).withColumn("weight", F.least(weight, F.lit(MOST_WEIGHT)))
    strong = ((F.col("pos") >= LEAST_CONTEXTS) & (F.col("sure") >= LEAST_WEIGHT)) | (
        F.col("form").isin(*known) & (F.col("pos") + F.col("neg") >= LEAST_CONTEXTS))
    rows = weighed.where(strong).collect()  # forms of the bounded sample
    signs = frozenset(r.form for r in rows if r.pos >= LEAST_CONTEXTS and r.sure >= LEAST_WEIGHT and not r.form.endswith("-"))
    known |= {r.form: max(0.0, r.weight) for r in rows if not r.form.endswith("-")}
    model = Model(known, {r.form[:-1]: r.weight for r in rows if r.form.endswith("-")}, signs)

    def evidence(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([scorer.evidence(t or "") for t in batch.column("text").to_pylist()], pa.list_(pa.float64())),
                 batch.column("toxic")], ["evidence", "toxic"])

    found = texts.select("text", "toxic").mapInArrow(evidence, "evidence array<double>, toxic int").toPandas()
    counts = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    y = found["toxic"].to_numpy(float)
    each = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))
    model.line = _logistic(np.stack(found["evidence"]), y, each / each.mean())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression with a weak ridge, by Newton steps; returns the weights and the offset."""
    design = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(design.shape[1]), np.diag([0.1] * x.shape[1] + [0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design.T * (each * p * (1 - p))) @ design + ridge, design.T @ (each * (y - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
    return tuple(map(float, beta))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text, one row per input row.

    Clauses end at ``. ! ? ;`` and line ends. Only the words count: no other column is read but the id,
    which is passed on. A null or empty text has the score of a text without hostile words; null ids and
    repeated rows are kept. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
