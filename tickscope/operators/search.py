"""Substring search over item names by stored trigram postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 3


def name_postings(items: DataFrame) -> DataFrame:
    """``gram, id``: the distinct trigrams of each lower-cased name, in order of trigram and id.

    Written as Parquet, a search for a few trigrams skips all other row groups. The order is by range, so a trigram that most names hold
    spreads over many tasks. Names that are null or shorter than a trigram have no postings.
    """
    lowered = items.select("id", F.lower("market_hash_name").alias("_name")).filter(F.length("_name") >= SIZE)
    starts = F.sequence(F.lit(1), F.length("_name") - (SIZE - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("_name"), i, F.lit(SIZE))))
    return lowered.select(F.explode(grams).alias("gram"), "id").repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def mandatory_grams(query: str) -> list[str]:
    """Trigrams that every name with a match of the LIKE pattern ``query`` holds; none for short or mostly wild patterns."""
    found, run, characters = [], "", iter(query)
    for c in characters:
        if c in "%_":
            found.append(run)
            run = ""
        else:
            run += next(characters, "") if c == "\\" else c
    found.append(run)
    return sorted({text[i:i + SIZE] for text in found for i in range(len(text) - SIZE + 1)})


def matching_items(items: DataFrame, query: str, postings: DataFrame | None = None) -> DataFrame:
    """The items whose name contains ``query`` in any case; ``%`` and ``_`` are wildcards, an empty query matches nothing.

    With ``postings`` of these items, only names that hold all mandatory trigrams are compared with the pattern. Patterns
    without one are compared with all names.
    """
    if not query:
        return items.filter(F.lit(False))
    grams = mandatory_grams(query.lower())
    if postings is not None and grams:
        held = postings.filter(F.col("gram").isin(grams)).groupBy("id").agg(F.count_distinct("gram").alias("_n"))
        items = items.join(held.filter(F.col("_n") == len(grams)).select("id"), "id", "left_semi")
    return items.filter(F.lower("market_hash_name").like(f"%{query.lower()}%"))
