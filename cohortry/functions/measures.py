"""Text, set and vector measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """Ratio as a double; NULL when the whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    """Shared members over all members; NULL when both sides are empty or one is NULL."""
    return share(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right)))


def token_set(text: Column) -> Column:
    """Distinct lower-cased words of a text."""
    words = F.split(F.lower(text), r"[ \n\t]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def token_count(text: Column) -> Column:
    """Number of words of a text."""
    return F.size(F.filter(F.split(text, r"[ \n\t]+"), lambda w: w != ""))


def hits_per_100(text: Column, pattern: str) -> Column:
    """Matches of a lexicon pattern per 100 words."""
    return share(F.regexp_count(F.lower(text), F.lit(pattern)) * 100, token_count(text))


def mentions(text: Column, values: Sequence[Column]) -> Column:
    """How many of the values occur in the text, ignoring case."""
    found = [F.coalesce(F.lower(text).contains(F.lower(v.cast("string"))), F.lit(False)).cast("int") for v in values]
    total = found[0]
    for hit in found[1:]:
        total = total + hit
    return total


def dot(left: Column, right: Column) -> Column:
    """Inner product of two arrays in double."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity in double; NULL when a side is a zero vector."""
    return dot(left, right) / F.nullif(F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)), F.lit(0.0))
