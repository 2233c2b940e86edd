"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fogline.functions.runtime import materialize, small

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Times that a document can be taken at most.
MAX_REPEATS = 3
#: Blocks hold this many words at most, and the smallest target at least so many blocks.
MAX_BLOCK, LEAST_BLOCKS = 2048, 64
#: Ranges of the seeded order within which running sums are made; the rows of one range of a source meet in one task.
ORDER_DIGITS = 3


def measured(docs: DataFrame, seed: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Narrow rows: doc_id, source, size in words (null: 0) and the seeded key that orders a source's documents."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: place, weight, source_size, target, numerator, block.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share all words. A source whose share is above
    MAX_REPEATS times its size gets just that, and the others share the rest; in the order of cap per weight the capped
    sources come first, so running sums find them at once. ``numerator`` is the target times a common integer. This
    table has a row for each source, and its windows see no others.
    """
    whole = W.partitionBy()
    before = W.orderBy("ratio", "place").rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    base = base.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    base = base.withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * MAX_REPEATS)
    base = base.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    run = base.withColumns({"total": F.sum("source_size").over(whole), "spent": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    run = run.withColumn("full", wide("weight") * wide("total") - wide("weight") * wide("spent") >= wide("cap") * wide("weights"))
    first = lambda c: F.max(F.when(~F.col("full"), c)).over(whole)
    # of the sources that aren't full the first has the most words and weights left, which all of them share
    run = run.withColumns({"rest": F.coalesce(first(F.col("total") - F.col("spent")), F.lit(0)), "open": F.coalesce(first(F.col("weights")), F.lit(1))})
    numerator = F.when(F.col("full"), F.col("cap").cast("double") * F.col("open")).otherwise((F.col("weight") * F.col("rest")).cast("double"))
    out = run.withColumn("numerator", numerator).withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("numerator") / F.col("open")))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole)
    block = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(F.coalesce(least, F.lit(1.0)) / LEAST_BLOCKS))).cast("long")
    return out.select("source", "place", "weight", "source_size", "target", "numerator", "total", block.alias("block"))


def quotas(sources: DataFrame, shards: int) -> DataFrame:
    """(source, shard, upto): blocks that a source gives to the shards 0 to ``shard``, by highest quotients.

    Seats go to the largest of numerator / (2 k + 1), k = 0, 1, ...; equal quotients go to the earlier source. A divisor
    method never takes a seat back when the house grows, so a shard's quota is the difference of two houses. A source's
    seats differ from its rounded share by at most its part of half the number of sources, plus one; only quotients in
    that range are ranked, so the work follows the number of sources and shards, not of blocks.
    """
    whole = W.partitionBy()
    house = F.floor((2 * F.col("total") + F.col("block")) / (2 * F.col("block")))
    wide = sources.where("numerator > 0").withColumns({"n": F.count("*").over(whole), "all": F.sum("numerator").over(whole), "house": house.cast("long")})
    wide = wide.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    wide = wide.withColumn("seats", F.floor(F.col("house") * (F.col("shard") + 1) / F.lit(shards)).cast("long"))
    part = F.col("numerator") / F.col("all")
    wide = wide.withColumn("near", F.floor(part * F.col("seats") + 0.5).cast("long")).withColumn("slack", (F.ceil(part * F.col("n") / 2) + 2).cast("long"))
    wide = wide.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.col("near") - F.col("slack")))
    ranked = wide.withColumn("k", F.explode(F.sequence("sure", F.col("near") + F.col("slack"))))
    ranked = ranked.withColumn("open", F.col("seats") - F.sum(F.when(F.col("k") == F.col("sure"), F.col("sure")).otherwise(0)).over(W.partitionBy("shard")))
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("shard").orderBy((F.col("numerator") / (2 * F.col("k") + 1)).desc(), "place")))
    return ranked.groupBy("source", "place", "shard").agg((F.max("sure") + F.sum((F.col("rank") <= F.col("open")).cast("long"))).alias("upto"))


def mix(docs: DataFrame, shards: int = 8, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, taken_by_shard.

    The documents of a source, in seeded order, form a stream of words that repeats MAX_REPEATS times; blocks are equal
    runs of that stream, and shard after shard takes its quota of the next blocks. ``taken`` counts the words of a
    document in the blocks taken, repeats included. Words add up to the quota times the block, so a source comes within
    about half a block of its target. Null texts have size 0 and are never taken; a null source is a source; repeated
    rows count each. A hot source's rows are dealt out by ranges of the seeded key, and running sums start from the
    ranges' sums.
    """
    rows = materialize(measured(docs, seed, doc_id, text, source), "mix")
    told = materialize(targets(rows), "mix-sources")
    given = quotas(told, shards).groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("upto"))
    told = told.join(given, "place", "left")
    at = rows.withColumn("range", F.substring("key", 1, ORDER_DIGITS)).withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    within = W.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("src").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = at.groupBy("src", "range").agg(F.sum("size").alias("sum")).select("src", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    placed = at.withColumn("run", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["src", "range"]).withColumn("offset", F.col("start") + F.col("run"))
    by = told.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), "source_size", "target", "block", "upto")
    full = placed.join(small(by), "src")
    size, whole = F.col("size"), F.col("source_size")

    def taken(upto):
        words = F.least(upto * F.col("block"), whole * MAX_REPEATS)
        passes = F.floor(words / F.greatest(whole, F.lit(1))).cast("long")
        return passes * size + F.least(size, F.greatest(F.lit(0).cast("long"), words - passes * whole - F.col("offset")))

    sums = F.transform(F.coalesce("upto", F.array_repeat(F.lit(0).cast("long"), shards)), taken)
    full = full.withColumn("sums", sums)
    each = F.transform("sums", lambda x, i: x - F.when(i > 0, F.get(F.col("sums"), i - 1)).otherwise(0))
    return full.select("doc_id", "source", "size", "source_size", "target", F.element_at("sums", -1).alias("taken"), each.alias("taken_by_shard"))


def apply_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed documents with the columns of ``docs``, whatever their names: whole copies, and the first words where a block ends inside.

    A document with ``taken`` words gives taken div size whole rows and, for a remainder, one row with the text up to that word and
    its n_chars. Documents that the mix leaves out, such as null and empty texts, are gone. Rows of one id, source and size are
    interchangeable and share the most that the mix takes of one of them. An empty table stays empty.
    """
    keys = [F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("words")]
    plan = mix(docs, seed=seed).where("taken > 0").groupBy(*keys).agg(F.max("taken").alias("taken"))
    row, words = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id_"), F.col("source").alias("of_"), words.alias("words_"))
    rows = rows.join(plan, F.col("id_").eqNullSafe(F.col("id")) & F.col("of_").eqNullSafe(F.col("of")) & (F.col("words_") == F.col("words")))
    parts = F.floor((F.col("taken") + F.col("words") - 1) / F.col("words")).cast("int")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(1), parts)))
    left = F.col("taken") - (F.col("part") - 1) * F.col("words")
    said = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    whole, cut = left >= F.col("words"), F.array_join(F.slice(said, F.lit(1), left.cast("int")), "")
    rows = rows.select("row", F.when(whole, F.col("row.text")).otherwise(cut).alias("cut"), whole.alias("whole"))
    told = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        told["n_chars"] = F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("cut").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[told.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
