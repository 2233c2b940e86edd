"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.functions.runtime import materialize
from fogline.llm.bitmaps import filter_of, may_have

#: Characters in the prefix whose hash refines groups of equal length.
PREFIX_CHARS = 64
#: A group is hot if it has this part of all rows or more; so there are at most HOT_PART hot groups, which bounds their broadcast.
HOT_PART = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A text with A-Z in lower case; where all characters are ASCII, that is what ``lower`` does, which is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def group_key(text: Column) -> Column:
    """Hash of the byte length and the normalised prefix: equal texts share it."""
    return F.xxhash64(F.octet_length(text), F.translate(F.substring(text, 1, PREFIX_CHARS), UPPER, LOWER))


def candidates(docs: DataFrame, text: str = "text") -> Column:
    """Whether a row may have a partner: its length occurs twice or more, and so does its (length, prefix) among such rows.

    Lengths that occur once are dropped before any prefix is hashed. Both steps count before they shuffle and leave a filter of
    a fixed size; if more groups than fit are left, more texts are hashed in full, and results stay the same.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    length = F.octet_length(body).cast("long")
    lengths = docs.groupBy(length.alias("n")).count().where("count > 1")
    same_length = may_have(filter_of(lengths, F.col("n")), length)
    prefixes = docs.where(same_length).groupBy(group_key(body).alias("k")).count().where("count > 1")
    return same_length & may_have(filter_of(prefixes, F.col("k")), group_key(body))


def decisions(docs: DataFrame, hash_all: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, text_sha256, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty; whole texts are hashed, however long. Of equal texts
    the row with the largest doc_id stays; null ids come below all others. Of repeated rows (same id, same text) exactly one is
    marked kept. ``text_sha256`` is null for rows that no refinement step found a partner for, unless ``hash_all``. An empty table
    stays empty; other columns, whatever their names, are not read. Groups are counted before each shuffle; hot ones, of which there
    can be HOT_PART at most, are sent to the rows, the others are joined.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    may = candidates(docs, text)
    sha = F.sha2(lowered(body), 256)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), may.alias("candidate"), (sha if hash_all else F.when(may, sha)).alias("text_sha256"))
    own = materialize(rows.groupBy("doc_id", "n_bytes", "text_sha256", "candidate").agg(F.count("*").alias("n_rows")), "dedup")
    groups = own.where("candidate").groupBy("n_bytes", "text_sha256").agg(F.max("doc_id").alias("keep"), F.sum("n_rows").alias("size"), F.count("*").alias("members")).where("members > 1")
    groups = materialize(groups, "groups")
    n = own.agg(F.sum("n_rows")).first()[0] or 0
    named = groups.select(F.concat(F.col("n_bytes").cast("string"), F.lit(":"), "text_sha256").alias("key"), "keep", "size")
    hot = named.where(F.col("size") * HOT_PART >= n).select("key", F.col("keep").alias("hot_keep"), F.col("size").alias("hot_size"))
    name = F.when(F.col("candidate"), F.concat(F.col("n_bytes").cast("string"), F.lit(":"), "text_sha256"))
    met = own.withColumn("key", name).join(F.broadcast(hot), "key", "left")
    # rows that need no other group get keys of their own, so that they spread
    met = met.withColumn("key", F.when(F.col("key").isNotNull() & F.col("hot_size").isNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id", "n_bytes").cast("string"))))
    joined = met.join(named.where(F.col("size") * HOT_PART < n), "key", "left")
    size, keep = F.coalesce("hot_size", "size"), F.coalesce("hot_keep", "keep")
    keep = F.when(size.isNull(), F.col("doc_id")).otherwise(keep)
    copy = F.explode(F.when(F.col("n_rows") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), "n_rows")))
    out = joined.select("doc_id", "n_bytes", "text_sha256", keep.alias("keep_id"), F.coalesce(size, "n_rows").cast("long").alias("group_size"), copy.alias("copy"))
    return out.select("doc_id", "n_bytes", "text_sha256", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns, whatever their names; decisions are those of ``decisions``.

    A filter finds the rows whose id is one of a row to drop or of a repeated row; these alone are shuffled, and looked up by id and
    digest. Of repeated rows of one id and text, one stays.
    """
    by = decisions(docs, False, doc_id, text).where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("any_kept"))
    marked = materialize(by.where("not any_kept or n > 1").select("doc_id", "text_sha256", F.col("any_kept").alias("one")), "marked")
    maybe = may_have(filter_of(marked, F.xxhash64("doc_id")), F.xxhash64("id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    asked = rows.where(maybe).select("row", "id", F.sha2(lowered(F.col("body")), 256).alias("sha"))
    asked = asked.join(marked, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256")), "left").select("row", "id", "sha", "one")
    stays = rows.where(~maybe).select("row").unionByName(asked.where("one is null").select("row"))
    if marked.where("one").limit(1).count():
        stays = stays.unionByName(asked.where("one").groupBy("id", "sha").agg(F.first("row").alias("row")).select("row"))
    return stays.select("row.*")
