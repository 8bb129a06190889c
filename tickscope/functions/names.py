"""Item names: decoding, classification, version parsing and building."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name vocabulary of the marketplace.
WEARS = ["Factory New", "Minimal Wear", "Field-Tested", "Well-Worn", "Battle-Scarred"]
STAR = "★"
GLOVE_WORDS = ["Gloves", "Wraps"]
AGENT_WORDS = [
    "NSWC SEAL", "Guerrilla Warfare", "Sabre", "TACP", "Professionals",
    "FBI", "SWAT", "Gendarmerie", "KSK", "Agent",
]
CONTAINER_WORDS = ["Case", "Capsule", "Package", "Pin"]

WEAR_PATTERN = r"(\((?:" + "|".join(WEARS) + r")\))"
# "<base> (<version>) (<wear>)" and "<base> (<wear>)"
VERSIONED_PATTERN = r"(?s)^\s*(.*?)\s*\(([^()]+)\)\s*" + WEAR_PATTERN + r"\z"
WORN_PATTERN = r"(?s)^\s*(.*?)\s*" + WEAR_PATTERN + r"\z"


def _any_of(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def item_name(raw: Column) -> Column:
    """Percent-decoded name without ``.csv``; ``+`` and broken escapes stay as they are."""
    text = F.replace(raw, F.lit(".csv"), F.lit(""))
    literal = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(literal)


def item_type(name: Column) -> Column:
    """Category of a decoded name; rules are ordered and case-sensitive."""
    return (
        F.when(name.contains(STAR) & _any_of(name, GLOVE_WORDS), F.lit("Glove"))
        .when(name.contains(STAR), F.lit("Knife"))
        .when(name.contains("Sticker |") | name.startswith("Sticker"), F.lit("Sticker"))
        .when(name.contains("Music Kit |"), F.lit("Music Kit"))
        .when(name.contains("Patch |"), F.lit("Patch"))
        .when(_any_of(name, AGENT_WORDS), F.lit("Agent"))
        .when(_any_of(name, [f"({w})" for w in WEARS]), F.lit("Weapon Skin"))
        .when(_any_of(name, CONTAINER_WORDS), F.lit("Container/Collectible"))
        .otherwise(F.lit("Agent"))
    )


def version(name: Column) -> Column:
    """Text of the parenthesis right before the wear suffix, or null."""
    return F.nullif(F.regexp_extract(name, VERSIONED_PATTERN, 2), F.lit(""))


def base_name(name: Column) -> Column:
    """The name without its version; unchanged when it has none."""
    stem = F.regexp_extract(name, VERSIONED_PATTERN, 1)
    wear = F.regexp_extract(name, VERSIONED_PATTERN, 3)
    return F.when(version(name).isNotNull(), F.concat(stem, F.lit(" "), wear)).otherwise(name)


def versioned_name(name: Column, wanted: Column) -> Column:
    """Insert a version before the wear suffix, or append it when there is no suffix."""
    wear = F.regexp_extract(name, WORN_PATTERN, 2)
    stem = F.regexp_extract(name, WORN_PATTERN, 1)
    part = F.concat(F.lit(" ("), wanted, F.lit(")"))
    return (
        F.when(wanted.isNull() | wanted.isin("", "default"), name)
        .when(wear != "", F.concat(stem, part, F.lit(" "), wear))
        .otherwise(F.concat(name, part))
    )
