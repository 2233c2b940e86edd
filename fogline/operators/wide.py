"""Reach from one set of starts in all worlds at once: a row has the masks of all its worlds side by side, as columns m0, m1 and so on.

A graph so has one row an edge and the state one row a node, in place of one for each 64 worlds of either; a round reads each edge once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.functions.coins import CHUNK, edge_key
from fogline.functions.costs import chance
from fogline.functions.many_coins import toss_batches
from fogline.functions.runtime import Buckets, buckets_for, partitions_of_shuffles, shuffle_partitions

#: Edges times worlds that a task tosses, where there are too few for all partitions of a shuffle.
TASK_WORLDS = 5_000_000
#: Buckets of a graph of many edges, and edges of a bucket beyond these: in few buckets more messages to a node meet before they are shuffled.
LEAST_BUCKETS, BUCKET_ARCS = 32, 1_000_000


def none() -> Column:
    return F.lit(0).cast("long")


def names(worlds: int, name: str = "m") -> list[str]:
    return [f"{name}{i}" for i in range((worlds - 1) // CHUNK + 1)]


def every(worlds: int) -> list[Column]:
    """The masks of all worlds."""
    left = [min(CHUNK, worlds - CHUNK * i) for i in range(len(names(worlds)))]
    return [F.lit(-1 if n == CHUNK else 2**n - 1).cast("long") for n in left]


def some(columns: Sequence[str]) -> Column:
    """Whether there is a world in any of the masks."""
    out = F.col(columns[0])
    for c in columns[1:]:
        out = out.bitwiseOR(F.col(c))
    return out != 0


def without(mask: str | Column, other: str | Column) -> Column:
    mask = F.col(mask) if isinstance(mask, str) else mask
    return mask.bitwiseAND(F.bitwise_not(F.coalesce(other, none())))


def narrow(rows: DataFrame, columns: Sequence[str], name: str = "mask") -> DataFrame:
    """The masks ``columns`` one below the other: ``chunk`` and ``name`` in place of them, without masks that have no world.

    No row is left out before: Spark would look for what a test of all masks says of each of them, in each selection of them.
    """
    each = F.posexplode_outer(F.array(*columns)).alias("chunk", name)
    return rows.select(*[c for c in rows.columns if c not in columns], each).where(F.col(name) != 0)


def widened(rows: DataFrame, by: Sequence[str], worlds: int, mask: str) -> DataFrame:
    """(by, m0, m1 and so on) of rows (by, chunk, ``mask``)."""
    each = [F.coalesce(F.bit_or(F.when(F.col("chunk") == i, F.col(mask))), none()).alias(m) for i, m in enumerate(names(worlds))]
    return rows.groupBy(*by).agg(*each)


def wide_masks(edges: DataFrame, worlds: int) -> DataFrame:
    """(src, dst, m0, m1 and so on) of the edges that exist in some world, of any color, with the coins of ``edge_masks``. Not written: each use tosses."""
    parts, each = shuffle_partitions(edges.sparkSession), max(1, TASK_WORLDS // worlds)
    parts = min(parts, -(-max(1, edges.limit(parts * each).count()) // each))
    rows = edges.repartition(parts).select("src", "dst", edge_key(edges.columns).alias("key"), chance(edges.columns).alias("p")).where("p > 0")
    return rows.mapInArrow(lambda batches: toss_batches(batches, worlds), "src long, dst long, " + ", ".join(f"{m} long" for m in names(worlds)))


def wide_buckets(spark: SparkSession, arcs: int) -> int:
    return min(buckets_for(spark, arcs), max(LEAST_BUCKETS, -(-arcs // BUCKET_ARCS)))


def lay_wide(arcs: DataFrame, buckets: int) -> Buckets:
    """Arcs (node, next, m0, m1 and so on) in buckets by ``node``."""
    lie = Buckets(arcs.sparkSession, "wide", ["node"], buckets)
    lie.write(arcs.repartition(buckets, "node"))  # a file a bucket
    return lie


def wide_reach(laid: Buckets, begin: DataFrame, worlds: int, max_rounds: int = 10_000) -> DataFrame:
    """(node, m0, m1 and so on): the worlds in which each node is reached over the arcs ``laid`` from the rows ``begin`` (same columns, one
    a node). Only the frontier's messages are shuffled, combined by node first; arcs are read where they lie and not sorted.
    """
    ms, fs, news = names(worlds), names(worlds, "f"), names(worlds, "a")
    states = Buckets(begin.sparkSession, "wide-reach", ["node"], laid.buckets)
    with partitions_of_shuffles(begin.sparkSession, laid.buckets):
        state = states.write(begin.select("node", *ms, *[F.col(m).alias(f) for m, f in zip(ms, fs, strict=True)]).repartition(laid.buckets, "node"))
        for _ in range(max_rounds):
            front = state.where(some(fs)).select("node", *fs)
            moved = laid.rows.join(front.hint("shuffle_hash"), "node").select(F.col("next").alias("node"), *[F.col(f).bitwiseAND(F.col(m)).alias(a) for f, m, a in zip(fs, ms, news, strict=True)])
            add = moved.where(some(news)).groupBy("node").agg(*[F.bit_or(a).alias(a) for a in news])
            both = state.select("node", *ms).join(add.hint("merge"), "node", "full")
            had = {m: F.coalesce(m, none()) for m in ms}
            grown = both.select("node", *[had[m].bitwiseOR(F.coalesce(a, none())).alias(m) for m, a in zip(ms, news, strict=True)], *[F.coalesce(a, none()).bitwiseAND(F.bitwise_not(had[m])).alias(f) for m, a, f in zip(ms, news, fs, strict=True)])
            state = states.write(grown, some(fs))
            if states.watched == 0:
                states.forget()
                return state.select("node", *ms)
    raise RuntimeError(f"nodes are still reached after {max_rounds} rounds")
