"""Shortest distances, side-track penalties and the r most reliable walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fogline.functions.runtime import Rounds, materialize
from fogline.operators.graph import identified, with_cost, with_paths


def distances(edges: DataFrame, ends: DataFrame, reverse: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """(target, node, dist, parent): the least cost from each node to each target of ``ends`` (target), and the id of its first edge.

    With ``reverse`` False distances lead away from the target. Rounds relax all edges out of nodes that improved; among
    equal costs the edge of the smaller id is the parent.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    arcs = materialize(with_cost(identified(edges)).select(F.col(a).alias("node"), F.col(b).alias("next"), "cost", F.col("edge_id").alias("edge")), "arcs")
    rounds = Rounds("dist")
    state = rounds.write(ends.select("target", F.col("target").alias("node"), F.lit(0).cast("long").alias("dist"), F.lit(None).cast("long").alias("parent"), F.lit(True).alias("fresh")).distinct())
    for _ in range(max_rounds):
        moved = state.where("fresh").join(arcs, "node").select("target", F.col("next").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.col("edge").alias("parent"))
        both = state.select("target", "node", "dist", "parent", F.lit(0).alias("new")).unionByName(moved.withColumn("new", F.lit(1)))
        # a start has no parent, and a null sorts first
        best = both.groupBy("target", "node").agg(F.min(F.struct("dist", "parent")).alias("b"), F.min(F.when(F.col("new") == 0, F.col("dist"))).alias("old"))
        state = rounds.write(best.select("target", "node", "b.dist", "b.parent", (F.col("old").isNull() | (F.col("b.dist") < F.col("old"))).alias("fresh")), F.col("fresh"))
        if rounds.watched == 0:
            return state.drop("fresh")
    raise RuntimeError(f"distances still improve after {max_rounds} rounds")


def penalties(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(target, edge_id, src, dst, color, penalty): how much longer a way to the target gets by taking an edge: d(dst) + cost - d(src)."""
    head = dist.select("target", F.col("node").alias("dst"), F.col("dist").alias("d_dst"))
    tail = dist.select("target", F.col("node").alias("src"), F.col("dist").alias("d_src"))
    return with_cost(identified(edges)).join(head, "dst").join(tail, ["target", "src"]).select("target", "edge_id", "src", "dst", "color", (F.col("d_dst") + F.col("cost") - F.col("d_src")).alias("penalty"))


def side_tracks(edges: DataFrame, dist: DataFrame, r: int) -> DataFrame:
    """Of each node the r edges of the least penalty that aren't its tree edge, with their rank; parallel ties all count."""
    sides = penalties(edges, dist).join(dist.select("target", F.col("node").alias("src"), "parent"), ["target", "src"])
    sides = sides.where(F.col("parent").isNull() | (F.col("edge_id") != F.col("parent")))
    rank = F.row_number().over(W.partitionBy("target", "src").orderBy("penalty", "edge_id"))
    return sides.withColumn("rank", rank).where(F.col("rank") <= r).select("target", "edge_id", "src", "dst", "color", "penalty", "rank")


def _ways_on(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, dst, rest): the least cost from each node to a target of each query, where there is a way."""
    ends = queries.select("query_id", F.explode("targets").alias("target")).distinct()
    dist = distances(edges, ends.select("target").distinct())
    return materialize(dist.join(ends, "target").groupBy("query_id", F.col("node").alias("dst")).agg(F.min("dist").alias("rest")), "ways-on")


def _edges_left(arcs: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """(query_id, dst, left): the least number of edges from each node to a target of each query, where ``most`` edges do."""
    told = layer = ends.select("query_id", "dst", F.lit(0).alias("left"))
    for n in range(1, most + 1):
        before = arcs.select(F.col("node").alias("from"), "dst").distinct()
        layer = materialize(layer.join(before, "dst").select("query_id", F.col("from").alias("dst"), F.lit(n).alias("left")).distinct(), "layer")
        told = told.unionByName(layer)
    return materialize(told.groupBy("query_id", "dst").agg(F.min("left").alias("left")), "edges-left")


def top_walks(edges: DataFrame, queries: DataFrame, r: int, hops: int | None = None, backtrack: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """(query_id, rank, cost, edges, path): the r cheapest walks from a source to the first target met, of up to ``hops`` edges if given,
    by the ids of their edges and printed.

    Equal costs are ordered by the edges' ids, the first edge first. Parallel edges give walks of their own. Unless ``backtrack``, a walk
    doesn't step straight back. Of walks that end alike, the r first by cost and edges are kept in each round, so the frontier stays
    small. With ``hops``, the later half of the rounds only goes to nodes from which a target is within the edges that remain. Without ``hops`` rounds go on until no open walk of a query can end within the cost of its r-th, and a search that
    ``max_rounds`` don't end raises. Where edges cost nothing, a walk that can only tie with the r-th isn't followed, as loops give
    such walks without end.
    """
    graph = identified(edges)
    found = _cheapest(_search(graph, queries, r, hops, backtrack, max_rounds), r)
    return with_paths(materialize(found, "walks"), graph, ["query_id", "rank"]).select("query_id", "rank", "cost", "edges", "path")


def walk_edges(arcs: DataFrame, queries: DataFrame, r: int, hops: int | None = None) -> DataFrame:
    """(query_id, rank, cost, edges) of ``top_walks``, on an identified graph."""
    return _cheapest(_search(arcs, queries, r, hops, False, 10_000), r).select("query_id", "rank", "cost", "edges")


def _search(graph: DataFrame, queries: DataFrame, r: int, hops: int | None, backtrack: bool, max_rounds: int) -> DataFrame:
    """(query_id, cost, edges) of walks that arrive, among them the r first of each query."""
    arcs = materialize(with_cost(graph).select(F.col("src").alias("node"), "dst", "cost", "edge_id"), "arcs")
    ends = materialize(queries.select("query_id", F.explode("targets").alias("dst"), F.lit(True).alias("end")).distinct(), "ends")
    begin = queries.select("query_id", F.explode("sources").alias("node"), "targets").where(~F.array_contains("targets", F.col("node")))
    labels = begin.select("query_id", "node", F.lit(None).cast("long").alias("prev"), F.lit(0).cast("long").alias("cost"), F.array().cast("array<bigint>").alias("edges"))
    ways_on = _ways_on(graph, queries) if hops is None else None
    half = 0 if hops is None else hops // 2
    near = None if hops is None else _edges_left(arcs, ends, half)
    free = hops is None and arcs.where("cost = 0").limit(1).count() > 0
    kept_rounds, found_rounds, open_rounds = Rounds("labels"), Rounds("found"), Rounds("open")
    found = found_rounds.write(labels.select("query_id", "cost", "edges").limit(0))
    for done in range(1, (max_rounds if hops is None else hops) + 1):
        moved = labels.withColumnRenamed("cost", "so_far").join(arcs, "node")
        if not backtrack:
            moved = moved.where(F.col("prev").isNull() | (F.col("dst") != F.col("prev")))
        moved = moved.select("query_id", "dst", F.col("node").alias("prev"), (F.col("so_far") + F.col("cost")).alias("cost"), F.concat("edges", F.array("edge_id")).alias("edges"))
        if near is not None and hops - done <= half:
            moved = moved.join(near.where(F.col("left") <= hops - done), ["query_id", "dst"]).withColumn("end", F.when(F.col("left") == 0, True)).drop("left")
        else:
            moved = moved.join(ends, ["query_id", "dst"], "left")
        if ways_on is not None:
            moved = moved.join(ways_on, ["query_id", "dst"])
        # all walks of a round have as many edges, so their order stays when they go on alike
        kept = moved.withColumn("near", F.row_number().over(W.partitionBy("query_id", "dst", "prev").orderBy("cost", "edges"))).where(F.col("near") <= r)
        kept = kept_rounds.write(kept.drop("near"), F.col("end").isNull())
        found = found_rounds.write(_cheapest(found.unionByName(kept.where("end").select("query_id", "cost", "edges")), r).drop("rank"))
        if kept_rounds.watched == 0:
            break
        labels = kept.where("end is null")
        if ways_on is not None:
            bound = found.groupBy("query_id").agg(F.when(F.count("*") >= r, F.max("cost")).alias("bound"))
            least = F.col("cost") + F.col("rest")
            labels = labels.join(bound, "query_id", "left").where(F.col("bound").isNull() | (least < F.col("bound") if free else least <= F.col("bound")))
        labels = open_rounds.write(labels.select("query_id", F.col("dst").alias("node"), "prev", "cost", "edges"), F.lit(True))
        if open_rounds.watched == 0:
            break
    else:
        if hops is None:
            raise RuntimeError(f"walks are still open after {max_rounds} rounds")
    return found


def _cheapest(found: DataFrame, r: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("cost", "edges"))
    return found.withColumn("rank", rank).where(F.col("rank") <= r)
