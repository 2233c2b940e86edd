"""Corpus pipeline over ``documents``: toxicity, exact dedup, near duplicates, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fogline.functions.runtime import arrow_rows, materialize, read
from fogline.llm import bitmaps, bpe, exact_dedup, mixing, signature_tree, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Rows that a Python worker gets at once in the last stage.
ROWS = 2000
#: The stages need trained lexicons, hashes of trees and token ids; tests hold them against brute force instead.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels of this table's documents, scores below 0.5.

    Null and empty texts have no entry of the lexicon and stay; all columns stay as they are. Without labels a small lexicon counts.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, A-Z lower-cased, the one with the largest doc_id. Nulls count as empty texts; of repeated rows one stays."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest doc_id.

    An id stands for all rows that have it; rows without an id, and texts without words, which link with nothing, stay.
    """
    gone = signature_tree.linked(docs).where("doc_id != component_id").selectExpr("doc_id as id").distinct()
    return bitmaps.without(docs, materialize(gone, "gone"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time up to the word where a block ends. Texts without words are never taken."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each text, and the digest of the bytes that the ids decode to. A null text has no ids.

    Ids are written here, within a bound on the rows that a Python worker gets at once: texts may be long.
    """
    with arrow_rows(spark, ROWS):
        return materialize(bpe.tokens(docs, RANKS), "tokens")


STAGES = [("toxicity", reject_toxic), ("exact dedup", exact_duplicates), ("near duplicates", near_duplicates), ("mixing", mix_sources), ("tokens", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written as Parquet and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
