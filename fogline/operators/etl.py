"""Lookups, counts and names around the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.functions.names import contains_any
from fogline.functions.runtime import small


def ids_of(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, id) of the names that the dictionary (name, id) has, in any case."""
    known = small(dictionary.select(F.lower("name").alias("_n"), "id"))
    return names.join(known, F.lower("name") == F.col("_n")).select("name", "id")


def missing(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name) of the names that the dictionary lacks."""
    known = small(dictionary.select(F.lower("name").alias("_n")))
    return names.join(known, F.lower("name") == F.col("_n"), "left_anti").select("name")


def names_of(ids: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, name) of the ids that the dictionary has."""
    return ids.join(small(dictionary.select("id", "name")), "id").select("id", "name")


def largest_id(edges: DataFrame) -> DataFrame:
    """The largest node id, in one row."""
    return edges.agg(F.max(F.greatest("src", "dst")).alias("max_id"))


def frequent_authors(publications: DataFrame, venues: list[str], min_count: int, number: int | None = None) -> DataFrame:
    """(author, count) of authors with at least ``min_count`` papers (author array, booktitle) at venues with one of the
    words, the most frequent first; ``number`` of them at most."""
    papers = publications.where(contains_any(F.col("booktitle"), venues)).select(F.explode("author").alias("author"))
    found = papers.groupBy("author").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)
    return found.orderBy(F.col("count").desc(), "author").limit(number) if number else found
