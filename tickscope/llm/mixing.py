"""Mixing sources to target weights: hash-threshold histograms, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickscope.llm.common import stored

LEVELS, DIGIT = 4, 12  # 4 digits of 12 bits: a 48-bit hash, refined one digit at a time
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 48 bits of an MD5 of id and text: the same in every run and on every cluster."""
    seed = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(seed), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """One row per source: ``sid`` (rank by code point, null last), ``source_size``, ``target``.

    Targets share ``share`` times all words by weight. A source stops at ``cap`` times its size and
    the excess goes to the others by weight, until none is above. Sources that stop are a prefix when
    they are ordered by cap / weight, so one running sum finds the level at which the rest share.
    The windows run over one narrow row per source, not over documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.select(
        "source", "source_size",
        F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long").alias("sid"),
    )
    weighted = ranked.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
        .cast("double")
    ).withColumn("most", F.col("source_size").cast("double") * cap)
    order = [F.col("most") / F.col("weight"), F.col("sid")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum(F.col("source_size")).over(everything).cast("double") * share
             - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    tried = weighted.withColumn("level", level).withColumn(
        "fits", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(
            order)), F.col("level").alias("level"))))
    return tried.select(
        "source", "sid", "source_size",
        F.least(F.col("most"), F.coalesce(F.min("fits").over(everything)["level"] * F.col("weight"), F.col("most")))
        .alias("target"),
    )


def mix_rules(docs: DataFrame, weights: Sequence[int], share: float, cap: int, id_col: str, text_col: str,
              source_col: str) -> tuple[DataFrame, DataFrame]:
    """``sizes``, one narrow row per document, and ``rules``, one row per source: ``source_size, target,
    times, edge, with_edge``."""
    sizes = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("pick"),
    ))
    empty = F.col("source_size") == 0
    targets = stored(source_targets(sizes, weights, share, cap).withColumn(
        "times", F.when(empty, F.lit(1)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    ).withColumn("rest", F.when(empty, F.lit(0.0)).otherwise(
        F.col("target") - F.col("times") * F.col("source_size").cast("double"))))
    rows = sizes.join(targets.select(F.col("source").alias("of"), "sid"), F.col("source").eqNullSafe(F.col("of")))
    edges = _boundaries(rows.select("sid", "pick", "size"), targets.select("sid", "rest"))
    return sizes, stored(targets.drop("rest").join(edges, "sid", "left").drop("sid"))


def _copies(pick: Column) -> Column:
    """How often a rule takes a row of this hash."""
    more = (pick < F.col("edge")) | ((pick == F.col("edge")) & F.col("with_edge"))
    return F.col("times") + F.coalesce(more, F.lit(False)).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document, one row per input row.

    Returns ``doc_id, source, size, source_size, target, copies, taken`` with ``taken = copies * size``.
    All documents are taken ``floor(target / source_size)`` times, and those below a hash threshold
    once more. The threshold comes from sums per (source, first 12 bits): the bucket in which the budget
    ends is known from them, and only that bucket is summed again by the next 12 bits, four times.
    Documents are never sorted. The last bucket (one document, or copies with the same id and text)
    is taken if that brings the source nearer to its target. A larger budget only adds documents.

    Nulls: a null text has size 0, a null source is a source of its own (last), a null id hashes as
    empty. Copies of one row decide alike. Documents of a source without words are taken once (0 words).
    An empty table gives no rows. Other columns are ignored.
    """
    sizes, rules = mix_rules(docs, weights, share, cap, id_col, text_col, source_col)
    joined = sizes.join(rules.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("copies", _copies(F.col("pick"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with their own columns, each as often as it is taken."""
    _, rules = mix_rules(docs, weights, share, cap, id_col, text_col, source_col)
    # The columns of a document travel as one, so none of them can clash with those of the rules.
    packed = docs.select(F.col(f"`{source_col}`").alias("of"), row_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("pick"),
                         F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    joined = packed.join(rules, F.col("of").eqNullSafe(F.col("source")))
    return joined.select("doc", F.explode(F.array_repeat(F.lit(1), _copies(F.col("pick")).cast("int"))).alias("copy")).select("doc.*")


def _boundaries(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per ``sid``: the hash ``edge`` in whose bucket the budget ends, and whether that bucket is taken."""
    state = budgets.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(LEVELS):
        below = (LEVELS - 1 - level) * DIGIT
        at = rows.withColumn("prefix", F.shiftright("pick", below + DIGIT))
        sums = at.join(state, ["sid", "prefix"]).groupBy(
            "sid", "rest", F.shiftright("pick", below).alias("bucket")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("sid").orderBy("bucket"))
        ends = sums.withColumn("upto", run).where(F.col("upto") > F.col("rest")).groupBy("sid").agg(
            F.min(F.struct("bucket", "rest", "words", "upto")).alias("e"))
        state = ends.select(
            "sid", (F.col("e.rest") - (F.col("e.upto") - F.col("e.words"))).alias("rest"),
            F.col("e.bucket").alias("prefix"), F.col("e.words").alias("words"))
        if level < LEVELS - 1:
            state = state.drop("words")
    return state.select("sid", F.col("prefix").alias("edge"), (F.col("words") - F.col("rest") < F.col("rest")).alias("with_edge"))
