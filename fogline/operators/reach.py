"""Reachability in possible worlds: 64 worlds a BIGINT, all queries and candidates in one dataflow.

An edge's mask has a bit for each world in which the edge exists; a node's mask has one for each world in which the node
is reached. Rounds send newly reached worlds over edges until there are none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.functions.coins import all_worlds, chunks, edge_key, toss
from fogline.functions.costs import chance, rounded_down
from fogline.functions.runtime import Buckets, buckets_for, materialize, shuffle_partitions, small
from fogline.operators.graph import NEUTRAL, bidirected

#: Masks of edges, from which on a graph is large enough for all partitions of a shuffle.
SMALL_GRAPH = 1_000_000


def edge_masks(edges: DataFrame, worlds: int, directed: bool = True, quantise: int | None = None) -> DataFrame:
    """(chunk, src, dst, color, em) of the edges that exist in some world; parallel copies of a color are combined.

    An undirected edge has one coin for both of its arcs. ``quantise`` rounds p down to a multiple of 1 / quantise.
    """
    p = chance(edges.columns)
    p = rounded_down(p, quantise) if quantise else p
    ends = ["src", "dst", "color"]
    arcs = toss(edges, worlds, ends, edge_key(edges.columns, directed), p)
    if not directed:
        arcs = bidirected(arcs).groupBy("chunk", *ends).agg(F.bit_or("em").alias("em"))
    return materialize(arcs, "masks")


def start(rows: DataFrame, worlds: int, node: str = "node") -> DataFrame:
    """Start rows (keys, node) as masks of all worlds."""
    return rows.withColumnRenamed(node, "node").withColumn("chunk", chunks(worlds)).withColumn("mask", all_worlds(F.col("chunk"), worlds))


def _decided(state: DataFrame, keys: Sequence[str], at: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """(keys, chunk, over): worlds in which one of the nodes ``at`` (some keys, node) is reached or, with ``wanted`` (some keys, wanted),
    the number of them, every one."""
    found = state.join(at, [c for c in at.columns if c in state.columns], "left_semi").groupBy(*keys, "chunk")
    if wanted is None:
        return found.agg(F.bit_or("mask").alias("over"))
    by = [c for c in wanted.columns if c != "wanted"]
    met = found.agg(F.bit_and("mask").alias("over"), F.count("*").alias("got"))
    full = met.join(wanted, by) if by else met.crossJoin(F.broadcast(wanted))  # one row
    return full.where("got = wanted").select(*keys, "chunk", "over")


def _added(state: DataFrame, add: DataFrame, by: Sequence[str], mask: str) -> DataFrame:
    """``state`` (by, mask) with the bits of ``add`` (by, add), and ``fresh``, those that are new."""
    none = F.lit(0).cast("long")
    had, got = F.coalesce(mask, none), F.coalesce("add", none)
    return state.select(*by, mask).join(add, list(by), "full").select(*by, had.bitwiseOR(got).alias(mask), got.bitwiseAND(F.bitwise_not(had)).alias("fresh"))


def lay(masks: DataFrame, edge_keys: Sequence[str] = (), reverse: bool = False, buckets: int | None = None) -> Buckets:
    """The edges as ``reach`` reads them, in buckets by the end they are left from; its ``rows`` serve several calls."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    arcs = masks.select(*edge_keys, "chunk", F.col(a).alias("node"), F.col(b).alias("next"), "color", "em")
    lie = Buckets(masks.sparkSession, "arcs", [*edge_keys, "chunk", "node"], buckets)
    lie.write(arcs)
    return lie


def _buckets(masks: DataFrame, begin: DataFrame, head: str) -> int:
    """Buckets for the edges and for the state, which has at most a row for each start row and node."""
    arcs, spark = masks.count(), masks.sparkSession
    if arcs > SMALL_GRAPH:
        return shuffle_partitions(spark)
    heads = masks.select(head).distinct().count()
    return buckets_for(spark, max(arcs, begin.count() * (heads + 1)))


def reach(masks: DataFrame, begin: DataFrame, keys: Sequence[str], allowed: DataFrame | None = None, allowed_keys: Sequence[str] = (), neutral: bool = True, reverse: bool = False, edge_keys: Sequence[str] = (), until_any: DataFrame | None = None, until_all: DataFrame | None = None, max_rounds: int = 10_000, laid: Buckets | None = None) -> DataFrame:
    """(keys, chunk, node, mask): the worlds in which each node is reached from the start rows ``begin``.

    ``allowed`` (allowed_keys, color) restricts the colors by query or candidate; its size is checked before it is
    broadcast. ``edge_keys`` are keys that the masks have too: each query or candidate then has edges of its own. Each round joins
    the frontier with the edges, combines by node, adds what is new to the state and writes that to the shared folder in place of the
    last one; the write counts what is new. Edges and state lie in buckets, so only the frontier and its messages are shuffled. A loop that ``max_rounds`` don't end raises. Without start rows the result is empty.

    With ``until_any`` or ``until_all`` (distinct rows of some keys and node) a world is decided once one, or every one, of the nodes is
    reached in it, and leaves the frontier of those keys: other nodes may then lack worlds that they would be reached in.
    ``laid`` are the masks as ``lay`` wrote them for the same keys and direction.
    """
    keys = list(keys)
    if allowed is not None:
        allowed = allowed.select(*allowed_keys, F.col("color").alias("_c")).distinct()
        if neutral:
            allowed = allowed.unionByName(allowed.select(*allowed_keys, F.lit(NEUTRAL).cast("long").alias("_c")).distinct())
        allowed = small(materialize(allowed, "allowed"))
    ends = until_all if until_all is not None else until_any
    wanted = None
    if ends is not None:
        ends = materialize(ends, "ends")
        if until_all is not None:
            each = [c for c in ends.columns if c in keys]
            wanted = small(materialize(ends.groupBy(*each).agg(F.count("*").alias("wanted")), "wanted"))
        ends = small(ends)
    by, spark, none = [*keys, "chunk", "node"], masks.sparkSession, F.lit(0).cast("long")
    begin = materialize(begin.select(*by, "mask"), "begin")
    buckets = _buckets(masks, begin, "src" if reverse else "dst") if laid is None else laid.buckets
    states = Buckets(spark, "reach", by, buckets)
    lie = lay(masks, edge_keys, reverse, buckets) if laid is None else laid
    arcs = lie.rows
    state = states.write(begin.groupBy(*by).agg(F.bit_or("mask").alias("mask")).withColumn("fresh", F.col("mask")))
    for _ in range(max_rounds):
        front = state.where("fresh != 0").drop("mask")
        if ends is not None:
            front = front.join(_decided(state, keys, ends, wanted), [*keys, "chunk"], "left")
            front = front.withColumn("fresh", F.col("fresh").bitwiseAND(F.bitwise_not(F.coalesce("over", none)))).where("fresh != 0")
        moved = front.join(arcs, [*edge_keys, "chunk", "node"])
        if allowed is not None:
            same = [moved[k] == allowed[k] for k in allowed_keys]
            on = moved["color"] == allowed["_c"]
            for c in same:
                on = on & c
            moved = moved.join(allowed, on, "left_semi")
        moved = moved.select(*keys, "chunk", F.col("next").alias("node"), F.col("fresh").bitwiseAND(F.col("em")).alias("add")).where("add != 0")
        state = states.write(_added(state, moved.groupBy(*by).agg(F.bit_or("add").alias("add")), by, "mask"), F.col("fresh") != 0)
        if states.watched == 0:
            if laid is None:
                lie.forget()
            states.forget()
            return state.drop("fresh")
    raise RuntimeError(f"nodes are still reached after {max_rounds} rounds")


def hits_at(reached: DataFrame, at: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, hits): in how many worlds each of the nodes ``at`` (some keys, node) is reached; 0 if in none."""
    shared = [c for c in at.columns if c in reached.columns]
    found = reached.join(at, shared, "left_semi").groupBy(*keys, "node").agg(F.sum(F.bit_count("mask")).alias("hits"))
    return found.select(*keys, "node", F.col("hits").cast("long").alias("hits"))


def worlds_of_any(reached: DataFrame, at: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, hits): worlds in which at least one of the nodes is reached."""
    shared = [c for c in at.columns if c in reached.columns]
    masks = reached.join(at, shared, "left_semi").groupBy(*keys, "chunk").agg(F.bit_or("mask").alias("mask"))
    return masks.groupBy(*keys).agg(F.sum(F.bit_count("mask")).cast("long").alias("hits"))


def worlds_of_all(reached: DataFrame, at: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, hits): worlds in which every one of the nodes is reached."""
    shared = [c for c in at.columns if c in reached.columns]
    by = [k for k in keys if k in at.columns]
    wanted = at.groupBy(*by).agg(F.count("*").alias("n")) if by else at.agg(F.count("*").alias("n"))
    masks = reached.join(at, shared, "left_semi").groupBy(*keys, "chunk").agg(F.bit_and("mask").alias("mask"), F.count("*").alias("got"))
    full = masks.join(wanted, by) if by else masks.crossJoin(F.broadcast(wanted))
    return full.where("got = n").groupBy(*keys).agg(F.sum(F.bit_count("mask")).cast("long").alias("hits"))
