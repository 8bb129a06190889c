"""Benchmark decontamination: a broadcast hash set of test n-grams against all windows of words; DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import stored
from tickscope.operators.joins import lookup

WINDOW = 10  # words of a window
# Java matches these ranges about nine times as fast as the negated class of all other ASCII characters.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"  # of a text without A-Z
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"  # the same words before lower-casing
BLOCK = 256  # windows of a document that are built at a time
# One broadcast holds at most so many n-grams and bytes; a larger benchmark is scanned in several parts.
PART_ROWS, PART_BYTES = 400_000, 48 << 20


def lowered(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _upto(first: int | Column, last: Column) -> Column:
    """first..last, empty where last is smaller; ``sequence`` would count downwards."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _grams(blocks: DataFrame, keep: list[str], lengths: list[int], with_own: bool = False) -> DataFrame:
    """``keep, n_words, pos, n, gram`` of the windows that start in a block; ``pos`` counts from 1 in the document.

    With ``with_own``, position 0 stands for the document itself, so that one scan gives its words and its hits. Only numbers are
    exploded; a window is put together behind that, in the same generated loop, which takes a fraction of the time
    of a lambda over strings.
    """
    none, step = F.array().cast("array<int>"), max(lengths, default=0) + 1
    codes = [F.when(F.col("base") == 0, F.array(F.lit(0))).otherwise(none)] if with_own else []
    for n in lengths:
        last = F.least(F.size("words") - n + 1, F.lit(BLOCK))
        codes.append(F.when(last >= 1, F.sequence(F.lit(step + n), last * step + n, F.lit(step))).otherwise(none))
    coded = blocks.select(*keep, "n_words", "base", "words", F.explode(F.concat(*codes) if codes else none).alias("code"))
    first = F.floor(F.col("code") / step).cast("int")
    size = F.col("code") % step
    gram = F.lit(None).cast("string")
    for n in lengths:
        gram = F.when(size == n, F.concat_ws(" ", *(F.get("words", first + (k - 1)) for k in range(n)))).otherwise(gram)
    return coded.select(*keep, "n_words", F.when(size == 0, 0).otherwise(F.col("base") + first).alias("pos"), size.alias("n"),
                        gram.alias("gram"))


def _blocks(docs: DataFrame, text: Column, keep: dict[str, Column], window: int) -> DataFrame:
    """``keep, n_words, base, words``: runs of ``BLOCK`` words and the ``window - 1`` behind them; one empty run for no words.

    Windows are built from such a run, so a long text is never blown up to all its n-grams at once. The words are
    bound by a lambda: as a plain column the optimizer would find them again for every run.
    """
    def runs(words: Column) -> Column:
        last = F.greatest(F.floor((F.size(words) - 1) / BLOCK).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(
            F.size(words).alias("n_words"), (b * BLOCK).alias("base"),
            F.transform(_upto(b * BLOCK, F.least(F.size(words), b * BLOCK + (BLOCK + window - 1)) - 1),
                        lambda i: F.get(words, i)).alias("words")))

    made = F.flatten(F.transform(F.array(words_of(text)), runs))
    return docs.select(*(c.alias(n) for n, c in keep.items()), F.explode(made).alias("run")).select(*keep, "run.*")


def item_grams(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``gram, n, items, set_id``, one row per distinct window of the benchmark, with the sorted ids that hold it.

    An item of fewer words than a window, but not none, is one window. A null id is taken as ``""``.
    """
    item = F.coalesce(F.col(item_col).cast("string"), F.lit(""))
    blocks = _blocks(benchmark, F.col(text_col), {"item": item}, window).where("n_words > 0")
    grams = _grams(blocks.where(F.col("n_words") >= window), ["item"], [window]).select("item", "gram", "n")
    whole = blocks.where(F.col("n_words") < window).select("item", F.concat_ws(" ", "words").alias("gram"), F.col("n_words").alias("n"))
    return grams.unionByName(whole).groupBy("gram", "n").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn(
        "set_id", F.md5(F.to_json(F.struct("items"))))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str,
           item_text_col: str) -> DataFrame:
    """``doc_id, digest, copies, n_words, spans, items``, one row per distinct (id, text)."""
    grams = stored(item_grams(benchmark, window, item_col, item_text_col))
    size = grams.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("gram") + 64), F.lit(0)).alias("b")).first()
    parts = max(1, -(-size.n // PART_ROWS), -(-size.b // PART_BYTES))
    lengths = sorted(r.n for r in grams.select("n").distinct().collect())  # at most ``window`` values
    text = F.col(text_col)
    blocks = _blocks(docs, text, {"doc_id": F.col(id_col), "digest": F.md5(text)}, window)
    hits = None
    for part in range(parts):
        mine = grams.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part).select(F.col("gram").alias("of"), "set_id")
        scanned = _grams(blocks, ["doc_id", "digest"], lengths, part == 0)
        met = scanned.join(F.broadcast(mine), F.col("gram") == F.col("of"), "left").where(
            F.col("set_id").isNotNull() | (F.col("pos") == 0)).select("doc_id", "digest", "n_words", "pos", "n", "set_id")
        hits = met if hits is None else hits.unionByName(met)
    real = F.col("pos") > 0
    merged = hits.groupBy("doc_id", "digest").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if(~real).alias("copies"),
        F.collect_set(F.when(real, F.struct("pos", "n"))).alias("windows"),
        F.collect_set(F.when(real, F.col("set_id"))).alias("sets"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "windows", lambda w: F.sequence(w["pos"] - 1, w["pos"] + w["n"] - 2)))))
    spans = F.flatten(F.transform(F.array(covered), _runs)).alias("spans")
    merged = stored(merged.select("doc_id", "digest", "n_words", "copies", "sets", spans))
    sets = grams.groupBy("set_id").agg(F.first("items").alias("items"))
    hit = merged.where(F.size("sets") > 0)
    named = lookup(hit.select("doc_id", "digest", F.explode("sets").alias("set_id")), sets, "set_id", derived=True).groupBy(
        "doc_id", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    items = hit.alias("h").join(named.alias("n"), F.col("h.doc_id").eqNullSafe(F.col("n.doc_id"))
                                & (F.col("h.digest") == F.col("n.digest"))).select("h.*", "n.items")
    clean = merged.where(F.size("sets") == 0).withColumn("items", F.array().cast("array<string>"))
    return items.unionByName(clean).drop("sets")


def _runs(p: Column) -> Column:
    """Maximal runs of sorted positions as ``array<struct<start, end>>``, end exclusive."""
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.cast("long").alias("start"), (e + 1).cast("long").alias("end")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Where benchmark items occur in documents: ``doc_id, n_words, spans, items``, one row per input row.

    Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. Every window of ``window``
    words of an item, or the whole of a shorter item, is looked up by its exact words in a broadcast hash table. ``spans`` are
    the maximal runs of document words inside such windows (positions from 0, end exclusive), ``items`` the sorted
    ids of the items with a window in the document.

    The table of n-grams is measured first: beyond ``PART_ROWS`` rows or ``PART_BYTES`` bytes the documents are scanned once per
    part of it, so no broadcast grows with the benchmark. Documents are read once a part and never shuffled, only hits
    and one narrow row per document are. Memory follows the words of the longest text, not its n-grams.

    Null and empty texts have no words, spans or items. Rows with equal id and text give equal rows. An
    empty benchmark hits nothing; an empty table gives no rows. Other columns are ignored.
    """
    found = _found(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    return found.select("doc_id", "n_words", "spans", "items", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def without_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    return _with_spans(docs, benchmark, options, lambda rows: rows.where(F.size("spans") == 0))


def without_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All documents, with the hit words and what stands between the words of one span cut from the text.

    Characters before the first and behind the last word of a span stay, and so do other columns (``n_chars``
    too). A null text stays null.
    """
    return _with_spans(docs, benchmark, options, lambda rows: rows.withColumn("text", _cut("text", "spans")))


def _cut(text: str, spans: str) -> Column:
    def pieces(gaps: Column, tokens: Column) -> Column:
        # Word k with the gap before it is token k. A span takes its words, and the gaps between them.
        after = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
        upto = F.concat(F.transform(spans, lambda s: s["start"]), F.array((F.size(gaps) - 1).cast("long")))
        return F.zip_with(after, upto, lambda a, b: F.concat(
            F.array_join(F.transform(_upto(a.cast("int"), (b - 1).cast("int")), lambda k: F.get(tokens, k)), ""),
            F.get(gaps, b.cast("int"))))

    # Lambdas bind the arrays; a plain column would be computed again for every word.
    words = F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))
    kept = _bound(F.split(text, RAW_WORD, -1), lambda gaps: _bound(
        F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), lambda tokens: F.array_join(
            pieces(gaps, tokens), "")))
    return F.when(F.size(spans) > 0, kept).otherwise(F.col(text))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with_spans(docs: DataFrame, benchmark: DataFrame, options: dict, act) -> DataFrame:
    """``act(rows, spans, text column)`` on the documents, whose columns are packed so that no name can clash."""
    settings = dict(window=WINDOW, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") | options
    found = _found(docs, benchmark, **settings).where(F.size("spans") > 0)
    known = found.select(F.to_json(F.struct("doc_id", "digest")).alias("key"), "spans")
    text = F.col(f"`{settings['text_col']}`")
    key = F.to_json(F.struct(F.col(f"`{settings['id_col']}`").alias("doc_id"), F.md5(text).alias("digest")))
    packed = docs.select(key.alias("key"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,end:bigint>>"))
    met = act(lookup(packed, known, "key", derived=True).withColumn("spans", spans))
    return met.select(*((F.col("text") if c == settings["text_col"] else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
