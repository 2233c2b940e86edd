"""Deterministic coins for possible worlds, equal in any SQL engine.

An edge isn't tossed in each world. Its coins give the gaps between the worlds in which it exists, which are geometric, so an edge of
probability p takes some p coins a world.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.functions.runtime import shuffle_partitions

#: Worlds in a mask.
CHUNK = 64
#: Edges times worlds that a task tosses, where there are too few for all partitions of a shuffle.
TASK_WORLDS = 200_000


def edge_key(columns: list[str], directed: bool = True) -> Column:
    """What names an edge in its coins; both arcs of an undirected edge share it. A column ``coin`` says it outright."""
    if "coin" in columns:
        return F.col("coin")
    a, b = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    parts = [a.cast("string"), F.lit(">"), b.cast("string"), F.lit("#"), F.col("color").cast("string")]
    if "edge_id" in columns:
        parts += [F.lit("@"), F.col("edge_id").cast("string")]
    return F.concat(*parts)


def uniform32(key: Column) -> Column:
    """A number from 0 to 2^32 - 1: the first eight hex digits of the MD5 of ``key``."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def existing(edges: DataFrame, worlds: int, by: Sequence[str], key: Column, p: Column) -> DataFrame:
    """(by, world): a row for each world, from 0 to worlds - 1, in which an edge exists; rows repeat where edges of a group do.

    ``p`` is a probability: 0 or less (or null) is never, 1 or more always. The i-th world in which an edge exists comes 1 + floor(ln(u) /
    ln(1 - p)) after the one before, where u = (coin + 0.5) / 2^32 and the coin is ``uniform32`` of i, a colon and the edge's key. The
    rows are dealt out before, as coins are far more work than the edges' bytes say, but few edges not to more tasks than they keep busy.
    """
    parts, each = shuffle_partitions(edges.sparkSession), max(1, TASK_WORLDS // worlds)
    parts = min(parts, -(-max(1, edges.limit(parts * each).count()) // each))
    rows = edges.select(*by, key.alias("_key"), F.when(p >= 1, 1.0).otherwise(p).alias("_p")).where("_p > 0").repartition(parts)
    miss = F.when((F.col("_p") > 0) & (F.col("_p") < 1), F.log1p(-F.col("_p")))

    def after(i: Column) -> Column:
        u = (uniform32(F.concat(i.cast("string"), F.lit(":"), "_key")) + 0.5) / 4294967296.0
        return F.when(F.col("_miss").isNull(), 0).otherwise(F.least(F.floor(F.log(u) / F.col("_miss")), F.lit(worlds))).cast("long") + 1

    def walk(begun: Column, first: Column, last: Column) -> Column:
        """Worlds one after the other, until one is past the last world."""
        over = lambda so_far: F.element_at(so_far, -1) >= worlds
        return F.aggregate(F.sequence(first, last), begun, lambda so_far, i: F.when(over(so_far), so_far).otherwise(F.concat(so_far, F.array(F.element_at(so_far, -1) + after(i)))))

    # nearly always so many coins are enough; where they aren't, the walk goes on, at most to a coin for each world
    expected = F.col("_p") * worlds
    few = F.least(F.lit(worlds + 1), F.ceil(expected + 8 * F.sqrt(expected) + 20)).cast("int")
    rows = rows.withColumn("_miss", miss).withColumn("_few", few).withColumn("_met", walk(F.array(F.lit(-1).cast("long")), F.lit(1), F.col("_few")))
    rest = walk(F.col("_met"), F.col("_few") + 1, F.lit(worlds + 2))
    rows = rows.withColumn("_met", F.when(F.element_at("_met", -1) >= worlds, F.col("_met")).otherwise(rest))
    # a plain explode would have Spark test the worlds for being none before the rows are dealt out, and so walk twice
    return rows.select(*by, F.explode_outer("_met").alias("world")).where(F.col("world").between(0, worlds - 1))


def toss(edges: DataFrame, worlds: int, by: Sequence[str], key: Column, p: Column) -> DataFrame:
    """(chunk, by, em): bit w of a mask is set if an edge of the group exists in world 64 * chunk + w, by ``existing``. Groups without a world
    have no row. Worlds are combined before they are shuffled.
    """
    rows = existing(edges, worlds, by, key, p)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("world") % CHUNK).cast("int"))
    return rows.groupBy(F.floor(F.col("world") / CHUNK).cast("int").alias("chunk"), *by).agg(F.bit_or(bit).alias("em"))


def all_worlds(chunk: Column, worlds: int) -> Column:
    """The mask of every world of a chunk."""
    left = F.lit(worlds) - chunk * CHUNK
    return F.when(left >= CHUNK, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), left.cast("int")) - 1)


def chunks(worlds: int) -> Column:
    """One row for each mask."""
    return F.explode(F.sequence(F.lit(0), F.lit((worlds - 1) // CHUNK)))
