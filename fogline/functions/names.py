"""Names: normalisation, labels and printed forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(name: Column) -> Column:
    """Trimmed, blanks to underscores, lower case."""
    return F.lower(F.regexp_replace(F.trim(name), " ", "_"))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words occurs, in any case."""
    found = F.lit(False)
    for word in words:
        found = found | F.lower(text).contains(word.lower())
    return found


def format_set(ids: Column) -> Column:
    """{1, 2, 3} in ascending order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ", "), F.lit("}"))


def ranked_label(rank: Column, name: Column) -> Column:
    """1. name"""
    return F.concat(rank.cast("string"), F.lit(". "), name)


def parse_ids(text: Column) -> Column:
    """A sorted array of the distinct ids in a blank-separated text."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: x.cast("long"))))
