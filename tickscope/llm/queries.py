"""The registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickscope.llm import ann, bpe_tree, decontaminate, jaccard, merkle, mixing, secrets, suffixes, token_files, toxicity, units, vectors, whitening
from tickscope.llm.common import read_table
from tickscope.session import prepare_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare_session(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def _count(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _joined(spans, kinds=None):
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op2_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    counts = [_count(F.col("spans"), k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("spans"), base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS pick
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid
  FROM sizes GROUP BY source),
weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(sid - 1) % 3 + 1] AS weight, source_size::DOUBLE * 2 AS most
  FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(most) OVER before, 0.0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM weighted WINDOW before AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (SELECT arg_min(level, (most / weight, sid)) FILTER (level * weight <= most) AS level FROM levels),
targets AS (
  SELECT l.source, l.source_size, least(l.most, coalesce(s.level * l.weight, l.most)) AS target
  FROM levels l, shared s),
budgets AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE floor(target / source_size)::BIGINT END AS times,
    CASE WHEN source_size = 0 THEN 0.0 ELSE target - floor(target / source_size) * source_size END AS rest
  FROM targets),
runs AS (
  SELECT b.source, pick, rest, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY b.source ORDER BY pick) AS upto
  FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source GROUP BY b.source, pick, rest),
edges AS (
  SELECT source, min(pick) AS edge, arg_min(words - (rest - (upto - words)) < rest - (upto - words), pick) AS with_edge
  FROM runs WHERE upto > rest GROUP BY source)
SELECT s.doc_id, s.size, b.source_size, b.target,
  (s.size * (b.times + CASE WHEN s.pick < e.edge OR (s.pick = e.edge AND e.with_edge) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
LEFT JOIN edges e ON s.source IS NOT DISTINCT FROM e.source
"""


@query("op3_source_mix", MIX_SQL)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file lies; a parameter of the operators, nothing is copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_files")
def token_file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(manifest, docs.schema["doc_id"].dataType.simpleString(), digest_only=True)


@query("op9_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    coalesce(label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x for x in embedding if x <> 0]) > 0, false) AS fit
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM (FROM v WHERE fit) a JOIN (FROM v WHERE fit) b
  ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, f.component_id, v.vec_id = f.component_id AS kept
FROM v JOIN found f ON f.a = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
"""


@query("op1_embedding_near_dedup", VECTOR_SQL)
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read_table(spark, sf_dir, "embeddings"))


@query("op7_nearest_vectors")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))


UNIT_SQL = r"""
WITH pieces AS (
  SELECT doc_id, unnest(parts) AS piece, unnest(range(1, len(parts) + 1)) AS number
  FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\n', chr(10) || chr(57344), 'g'),
    '([.,;:!?] )', '\1' || chr(57344), 'g'), chr(57344)) AS parts FROM documents)),
placed AS (
  SELECT *, trim(regexp_replace(lower(piece), '\s+', ' ', 'g')) AS plain,
    (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY number) - length(piece))::BIGINT AS start
  FROM pieces),
ranked AS (
  SELECT *, plain <> '' AND row_number() OVER (PARTITION BY plain ORDER BY doc_id, number) > 1 AS repeated,
    CASE WHEN plain = '' THEN 0 ELSE len(string_split(plain, ' ')) END AS words FROM placed),
runs AS (
  SELECT *, sum((plain <> '' AND NOT repeated)::INT) OVER (PARTITION BY doc_id ORDER BY number) AS run FROM ranked),
marked AS (
  SELECT *, repeated AND sum(words) FILTER (repeated) OVER (PARTITION BY doc_id, run) >= 20 AS gone FROM runs),
kept AS (
  SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY number) FILTER (NOT gone), '') AS text,
    count(*) FILTER (plain <> '')::BIGINT AS n_units, count(*) FILTER (gone)::BIGINT AS n_removed,
    coalesce(string_agg(start || ':' || (start + length(rtrim(piece, ' ' || chr(10)))), ',' ORDER BY number) FILTER (gone), '') AS removed
  FROM marked GROUP BY doc_id)
SELECT doc_id, n_units, n_removed, removed, length(text)::BIGINT AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""


@query("op10_line_dedup", UNIT_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = units.dedup_units(read_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    places = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return kept.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"),
                       F.array_join(places, ",").alias("removed"), F.length(text).cast("long").alias("kept_chars"),
                       F.sha2(text, 256).alias("kept_sha256"))


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


JACCARD_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] AS words FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM texts WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b USING (gram)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * c.n >= 4 * (x.n + y.n - c.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT f.a AS doc_id, coalesce(c.n, 0)::BIGINT AS n_links, f.component_id, f.a = f.component_id AS kept
FROM found f LEFT JOIN counts c ON c.a = f.a
"""


@query("op4_jaccard_join", JACCARD_SQL)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(read_table(spark, sf_dir, "documents")).drop("h")


@query("op8_repeated_bytes")
def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


LEAK_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
grams AS (
  SELECT DISTINCT item, n, unnest([array_to_string(words[i:i + n - 1], ' ') for i in range(1, len(words) - n + 2)]) AS gram
  FROM (SELECT item, words, least(len(words), 10) AS n FROM items WHERE len(words) > 0)),
windows AS (
  SELECT doc_id, n, unnest([{'pos': i, 'gram': array_to_string(words[i:i + n - 1], ' ')} for i in range(1, len(words) - n + 2)]) AS w
  FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(words) >= n),
hits AS (
  SELECT w.doc_id, w.w.pos AS pos, w.n, g.item FROM windows w JOIN grams g ON g.n = w.n AND g.gram = w.w.gram),
covered AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS place FROM hits),
counts AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN named i ON i.doc_id = d.doc_id
"""


@query("op11_benchmark_leaks", LEAK_SQL)
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


MERKLE_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(4294967295, list_reduce(list_concat([4294967295], [ord(d)::BIGINT for d in string_split(doc_id::VARCHAR, '')]),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
        lambda bits, k: CASE WHEN bits % 2 = 1 THEN xor(bits // 2, 3988292384) ELSE bits // 2 END))) % 3 = 0 AS picked
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n
  FROM (SELECT doc_id, coalesce(':' || lang, '-') AS grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN picked THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS changed FROM fields)),
nodes AS (
  SELECT grp, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT grp, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1
  GROUP BY grp, level, n, i // 8),
subroots AS (
  SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, n, i // 8),
every AS (SELECT grp, level, i, n, h FROM nodes UNION ALL SELECT '', level, i, n, h FROM tops),
siblings AS (
  SELECT grp, level, i, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM every WHERE n > 1 WINDOW run AS (PARTITION BY grp, level, i // 8 ORDER BY i)),
inner_paths AS (
  SELECT doc_id, leaf, grp, 0 AS level, i, coalesce(changed, leaf) AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT p.doc_id, p.leaf, p.grp, p.level + 1, p.i // 8, sha256(s.before || p.node || s.after), p.proof || s.before || s.after
  FROM inner_paths p JOIN siblings s ON s.grp = p.grp AND s.level = p.level AND s.i = p.i),
outer_paths AS (
  SELECT p.doc_id, p.leaf, r.subroot, 0 AS level, r.i, p.node, p.proof
  FROM inner_paths p JOIN subroots r ON r.grp = p.grp
  WHERE NOT EXISTS (FROM siblings s WHERE s.grp = p.grp AND s.level = p.level AND s.i = p.i)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.subroot, p.level + 1, p.i // 8, sha256(s.before || p.node || s.after), p.proof || s.before || s.after
  FROM outer_paths p JOIN siblings s ON s.grp = '' AND s.level = p.level AND s.i = p.i)
SELECT p.doc_id, p.leaf, p.subroot, t.h AS root, sha256(p.proof) AS proof_sha256, p.node AS folded_root, p.node = t.h AS verified
FROM outer_paths p JOIN tops t ON t.n = 1 AND t.level = p.level
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(merkle.build_manifest(read_table(spark, sf_dir, "documents")))


@query("op13_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    parts = F.arrays_zip("whitened", "explained")
    return rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(parts).alias("at", "part")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error")
