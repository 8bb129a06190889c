"""Secret scans: Boolean trigram queries derived from the rules, an inverted index per segment."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as regex_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import bounded_batches


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (ASCII classes), leftmost and non-overlapping, are kept when ``group`` has
    at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# Public credential formats that the base rules do not name.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# A trigram query: None (no condition), a trigram, or ("and" | "or", queries).
EXACT_LIMIT = 16


def _and(parts: Iterable) -> tuple | str | None:
    kept = tuple(dict.fromkeys(p for p in parts if p is not None))
    return kept[0] if len(kept) == 1 else ("and", kept) if kept else None


def _or(parts: Iterable) -> tuple | str | None:
    parts = tuple(dict.fromkeys(parts))
    if not parts or any(p is None for p in parts):
        return None
    return parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]):
    """What a text must contain if it contains one of ``strings``."""
    return _or(_and(s[i:i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def _walk(tokens) -> tuple[set[str] | None, object]:
    """(the strings that the expression can match, or None if they are too many; its query)."""
    exact: set[str] | None = {""}
    run: set[str] = {""}  # strings that end the part read so far and may be continued
    found: list = []

    def close():
        nonlocal run
        found.append(_of_strings(run))
        run = {""}

    for kind, value in tokens:
        strings, query = _node(kind, value)
        if strings is not None and len(run) * len(strings) <= EXACT_LIMIT:
            run = {a + b for a in run for b in strings}
        else:
            close()
            found.append(query)
            exact = None
    if exact is not None:
        return run, _of_strings(run)
    close()
    return None, _and(found)


def _node(kind, value) -> tuple[set[str] | None, object]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, None
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 6:
        return {chr(v).lower() for _, v in value}, None
    if kind is op.SUBPATTERN:
        return _walk(value[-1])
    if kind is op.BRANCH:
        parts = [_walk(p) for p in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= EXACT_LIMIT:
            return set().union(*(s for s, _ in parts)), _or(q for _, q in parts)
        return None, _or(q for _, q in parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _walk(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, None
        return None, query if low else None
    return None, None


def trigram_query(pattern: str):
    """The Boolean trigram query, over lower-cased text, that every match of ``pattern`` implies."""
    return _walk(regex_parser.parse(pattern))[1]


def query_trigrams(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(query_trigrams, query[1]))


# Bytes of a lower-cased text: ASCII letters in lower case, all bytes of other characters as 0.
LOWERED = bytes(ord(chr(b).lower()) if b < 128 else 0 for b in range(256))
SLICE = 1 << 20  # bytes whose trigrams are collected at a time


def _codes(data: bytes) -> np.ndarray:
    """Codes of the trigrams of lowered bytes: seven bits a byte."""
    at = np.frombuffer(data, np.uint8).astype(np.int32)
    return at[:-2] << 14 | at[1:-1] << 7 | at[2:]


def _distinct(text: str) -> np.ndarray:
    """Codes of the different trigrams of a whole text, collected in slices that overlap by two bytes."""
    data = text.encode().translate(LOWERED)
    parts = [np.unique(_codes(data[i:i + SLICE + 2])) for i in range(0, len(data) - 2, SLICE)]
    if not parts:
        return np.empty(0, np.int32)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Segment:
    """The inverted index of one batch of texts: for each trigram that occurs, the rows that hold it.

    Each text is passed over once; the pairs (trigram, row) are then sorted by trigram, so a posting is a slice.
    """

    def __init__(self, texts: list[str]):
        own = [_distinct(t) for t in texts]
        trigrams = np.concatenate([np.empty(0, np.int32), *own])
        rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(o) for o in own])
        order = np.argsort(trigrams, kind="stable")
        self.size, self.trigrams, self.rows = len(texts), trigrams[order], rows[order]

    def posting(self, trigram: str) -> frozenset[int]:
        if not trigram.isascii():  # no such trigrams are indexed; any text may hold it
            return frozenset(range(self.size))
        code = _codes(trigram.encode())[0]
        first, last = np.searchsorted(self.trigrams, [code, code + 1])
        return frozenset(self.rows[first:last].tolist())

    def candidates(self, query) -> frozenset[int]:
        """Rows that satisfy the query; every row for a rule without mandatory trigrams."""
        if query is None:
            return frozenset(range(self.size))
        if isinstance(query, str):
            return self.posting(query)
        connective, parts = query
        if connective == "or":
            return frozenset().union(*map(self.candidates, parts))
        rows = self.candidates(parts[0])
        for part in parts[1:]:
            if not rows:
                break
            rows &= self.candidates(part)
        return rows


class Scanner:
    """Compiled rules with their trigram queries."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text: (start, number of the rule, end), in this order."""
        segment = Segment(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, pattern, query) in enumerate(self.rules):
            for row in segment.candidates(query):
                out[row] += [(m.start(), number, m.end()) for m in pattern.finditer(texts[row])
                             if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for spans in out:
            spans.sort()
        return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Every secret of every whole text: ``doc_id, spans: array<struct<kind, start, end>>``, one row per input row.

    Spans count code points, end exclusive, ordered by start and then rule. Each Arrow batch is a
    segment with its own inverted index of all trigrams in its texts; the postings that the rules' queries name
    are combined and only candidate texts are searched. A rule without mandatory trigrams searches every text. The
    result does not depend on segments: the queries are implied by the patterns.

    A null or empty text has no spans; null ids and repeated rows are kept as they are. Nothing is
    shuffled, so no key can be hot.
    """
    bounded_batches(docs.sparkSession)
    kinds = [r.kind for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in row] for row in scanner.spans(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text",
             length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every secret replaced by ``[kind]``; a null text stays null.

    Overlapping spans are replaced together, under the kind that starts first. ``length_col``, if the
    table has it, is set to the new length.
    """
    bounded_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            columns = batch.columns
            new = [t if not spans else _replace(t, spans, rules)
                   for t, spans in zip(texts, scanner.spans([t or "" for t in texts]))]
            changed = [a is not b for a, b in zip(texts, new)]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length_at is not None:
                old = columns[length_at].to_pylist()
                columns[length_at] = pa.array([len(t) if c else n for t, c, n in zip(new, changed, old)],
                                              batch.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(rewrite, schema)


def _replace(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    parts, upto = [], 0
    for start, number, end in spans:
        if start >= upto:
            parts += [text[upto:start], f"[{rules[number].kind}]"]
        upto = max(upto, end)
    return "".join([*parts, text[upto:]])


def span_digest(spans: list[dict], kinds: set[str] | None = None) -> str:
    joined = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if kinds is None or s["kind"] in kinds)
    return hashlib.sha256(joined.encode()).hexdigest()
