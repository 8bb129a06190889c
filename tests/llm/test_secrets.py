import hashlib
import random
import re

from tickscope.llm import secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def random_texts():
    rng = random.Random(5)
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", "secret", "ſecret", "toKen", "=", ": ", '" : "', "abcdefgh",
             "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", " ", "\n", "é", "x", "short", "a.b/c+d=_-"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]


def test_base_spans_equal_a_full_scan(documents):
    texts = random_texts()
    got = secrets.find_secrets(documents(list(enumerate(texts)))).collect()
    kinds = {r.kind for r in secrets.BASE_RULES}
    for row in got:
        spans = [(s.kind, s.start, s.end) for s in row.spans if s.kind in kinds]
        assert spans == brute(texts[row.doc_id])


def test_messy_rows_and_long_texts(documents, messy):
    secret = "AKIA" + "Z" * 20
    rows = [*messy, (20, "é" * 200_000 + secret), (21, secret), (21, secret)]
    got = secrets.find_secrets(documents(rows)).collect()
    assert len(got) == len(rows)
    spans = sorted((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in got if r.spans)
    assert spans == [(20, [("access", 200_000, 200_024)]), (21, [("access", 0, 24)]), (21, [("access", 0, 24)])]
    assert secrets.find_secrets(documents([])).collect() == []


def test_queries_follow_from_the_patterns():
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query(r"[0-9a-f]+") is None
    assert secrets.trigram_query(r"(ab|cde)x*") is None  # one branch has no trigram
    assert secrets.trigram_query(r"(abcd|xyz)?q") is None
    assert secrets.trigram_query(r"(?i:ABC)d?ef") == ("or", (("and", ("abc", "bcd", "cde", "def")), ("and", ("abc", "bce", "cef"))))


def test_redaction(documents):
    docs = documents([(1, "my password = hunter2hunter2 ok"), (2, None), (3, "clean"), (4, "token=" + "a1" * 20)])
    rows = {r.doc_id: r for r in secrets.redacted(docs).collect()}
    assert rows[1].text == "my [assign] ok" and rows[1].n_chars == len("my [assign] ok")
    assert rows[2].text is None and rows[3].text == "clean" and rows[4].text == "[assign]"
    assert secrets.redacted(docs).columns == docs.columns


def test_digest():
    spans = [{"kind": "hex", "start": 1, "end": 3}, {"kind": "more", "start": 2, "end": 4}]
    assert secrets.span_digest(spans, {"hex"}) == hashlib.sha256(b"hex:1:3").hexdigest()


def test_postings_equal_a_search_of_every_text(monkeypatch):
    monkeypatch.setattr(secrets, "SLICE", 16)  # trigrams across slices are not lost
    texts = [*random_texts()[:200], "", "ab", "abc", "\x00\x00\x00", "éé", "AKİA", "x" * 50]
    segment = secrets.Segment(texts)
    wanted = set().union(*(secrets.query_trigrams(secrets.trigram_query(r.pattern))
                           for r in secrets.BASE_RULES + secrets.MORE_RULES)) | {"abc", "xxx", "\n  ", "zzz"}
    lowered = [t.translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    for trigram in wanted:
        assert segment.posting(trigram) == {i for i, t in enumerate(lowered) if trigram in t}
    assert segment.posting("aéb") == set(range(len(texts)))
    assert secrets.Segment([]).posting("abc") == frozenset()


def test_added_rules_equal_a_full_scan(documents):
    rng = random.Random(11)
    parts = ["-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "ghx_", "a1B2" * 9, "xoxb-", "xoxq-", "1234567890-", "AIza",
             "Zz_-9" * 7, "eyJ", "eyJhbGciOiJI", ".", "sig_nature", " ", "é", "AIZA", "Ghp_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-1234567890-", "AIza" + "Zz_-9" * 7,
              "eyJhbGciOiJI.eyJhbGciOiJI.sig_nature"]
    seen = set()
    for row in secrets.find_secrets(documents(list(enumerate(texts)))).collect():
        for rule in secrets.MORE_RULES:
            got = [(s.start, s.end) for s in row.spans if s.kind == rule.kind]
            assert got == [m.span() for m in re.finditer(rule.pattern, texts[row.doc_id], re.ASCII)]
            seen |= {rule.kind} if got else set()
    assert seen == {r.kind for r in secrets.MORE_RULES}
