"""Targeted influence maximisation: seeds from which a cascade reaches most targets, and its alternation with colors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.functions.costs import chance, miss_pct
from fogline.functions.runtime import Buckets, Rounds, materialize, small
from fogline.operators.reach import edge_masks, hits_at, reach, start


def collapse(edges: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """One edge an endpoint pair, with the chance that any of its chosen colors exists: (src, dst, p) of a graph that has p, and (src, dst,
    p_pct), in truncated percent, of one that has p_pct.

    Without ``chosen`` (color) all colors count; pairs without a chosen color stay, with 0.
    """
    exact = "p" in edges.columns
    edges = edges.withColumn("_miss", 1.0 - chance(edges.columns) if exact else (100 - F.col("p_pct")).cast("double") / 100.0)
    if chosen is not None:
        edges = edges.join(chosen.select("color").distinct().withColumn("_in", F.lit(True)), "color", "left").withColumn("_miss", F.when(F.col("_in"), F.col("_miss")).otherwise(1.0))
    # multiplied from the smallest on, so that it is the same each time
    miss = F.aggregate(F.array_sort(F.collect_list("_miss")), F.lit(1.0), lambda a, x: a * x)
    met = edges.groupBy("src", "dst").agg(miss.alias("_miss"))
    p = (1.0 - F.col("_miss")).alias("p") if exact else F.floor(F.round((1.0 - F.col("_miss")) * 100.0, 6)).cast("long").alias("p_pct")
    return met.select("src", "dst", p)


def noisy_or(edges: DataFrame) -> DataFrame:
    """(src, dst, n, miss): of each endpoint pair the number of edges and 100^n times the chance that none exists, exactly."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"), miss_pct(F.col("p_pct")).alias("miss"))


def target_masks(edges: DataFrame, targets: DataFrame, worlds: int) -> DataFrame:
    """(target, chunk, node, mask): the worlds in which a cascade from a node reaches a target, the target itself included.

    Walks the edges backwards from each target, so there is a row for each target and node that can reach it.
    """
    colored = edges if "color" in edges.columns else edges.withColumn("color", F.lit(0).cast("long"))
    seeds = targets.select(F.col("node").alias("target"), "node")
    return reach(edge_masks(colored, worlds), start(seeds, worlds), ["target"], reverse=True)


def cascade_hits(edges: DataFrame, sources: DataFrame, targets: DataFrame, worlds: int) -> DataFrame:
    """(node, hits): in how many worlds one cascade from all ``sources`` (node) reaches each of ``targets`` (node), if in any.

    An edge into a source adds nothing, as a source is reached in every world, so it isn't tossed.
    """
    sources = materialize(sources.select("node").distinct(), "sources")
    into = edges.join(sources.select(F.col("node").alias("dst")), "dst", "left_anti").select(edges.columns)
    return hits_at(reach(edge_masks(into, worlds), start(sources, worlds), []), targets.select("node").distinct(), [])


def spreads(masks: DataFrame) -> DataFrame:
    """(node, hits): targets reached from each node, summed over the worlds."""
    return masks.groupBy("node").agg(F.sum(F.bit_count("mask")).cast("long").alias("hits"))


def _best(gains: DataFrame) -> list:
    return gains.where("gain > 0").orderBy(F.col("gain").desc(), "node").limit(1).collect()


def seeds(masks: DataFrame, k: int, batch: int = 64) -> DataFrame:
    """(rank, node, hits, recounted): k seeds, each adding most targets to those that the earlier ones reach; hits add up.

    With fixed worlds the gain of a node only falls as seeds are added, so a gain counted before is a bound. A round recounts the
    ``batch`` nodes of the largest bounds, then all others whose bounds reach the best gain among these; no other node can be
    better, so seeds are those of counting all nodes in each round. ``recounted`` is how many nodes a round counted. Among equal
    gains the smaller node is picked; a node without gain isn't. The masks lie in buckets by node and aren't shuffled again; only a
    round's seed comes to the driver.
    """
    spark, lie = masks.sparkSession, Buckets(masks.sparkSession, "target-masks", ["node"])
    masks = lie.write(masks.select("target", "chunk", "node", "mask"))
    told, covered, total, none = [], None, 0, F.lit(0).cast("long")
    bounds = Rounds("bounds")
    gains = bounds.write(spreads(masks).withColumnRenamed("hits", "gain"), F.lit(True))
    n = bounds.watched

    def recount(nodes: DataFrame) -> DataFrame:
        """(node, gain) under what is covered."""
        own = masks.join(small(nodes.select("node")), "node", "left_semi").join(covered, ["target", "chunk"], "left")
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("cover", none)))
        return own.groupBy("node").agg(F.sum(F.bit_count(fresh)).cast("long").alias("gain"))

    for rank in range(1, k + 1):
        if covered is None:
            top = _best(gains)
        else:
            ahead = materialize(gains.where("gain > 0").orderBy(F.col("gain").desc(), "node").limit(batch), "ahead")
            counted = materialize(recount(ahead), "recounted")
            so_far = _best(counted)
            least = so_far[0]["gain"] if so_far else 1
            others = materialize(gains.where(F.col("gain") >= least).join(F.broadcast(ahead.select("node")), "node", "left_anti"), "others")  # ``batch`` rows
            counted = materialize(counted.unionByName(recount(others)), "recounted")
            n = counted.count()
            top = _best(counted)
            gains = bounds.write(gains.join(counted.withColumnRenamed("gain", "now"), "node", "left").select("node", F.coalesce("now", "gain").alias("gain")))
        if not top:
            break
        total += top[0]["gain"]
        told.append((rank, top[0]["node"], total, n))
        own = masks.where(F.col("node") == top[0]["node"]).select("target", "chunk", F.col("mask").alias("cover"))
        both = own if covered is None else covered.unionByName(own)
        covered = materialize(both.groupBy("target", "chunk").agg(F.bit_or("cover").alias("cover")), "covered")
    lie.drop()
    return spark.createDataFrame(told, "rank int, node long, hits long, recounted long")


def _some(edges: DataFrame) -> DataFrame:
    return edges.where(chance(edges.columns) > 0)


def alternate(edges: DataFrame, targets: DataFrame, rounds: int, n_seeds: int, k: int, r: int, worlds: int = 64, hops: int | None = None) -> DataFrame:
    """(round, kind, rank, id, hits): in turn, seeds on the graph under the current colors, then colors for these seeds.

    The first round uses all colors. Each round gives `seed` and `color` rows.
    """
    from fogline.operators.select import heuristic

    chosen, out = None, None
    for turn in range(1, rounds + 1):
        found = materialize(seeds(target_masks(_some(collapse(edges, chosen)), targets, worlds), n_seeds), "seeds")
        queries = found.agg(F.array_sort(F.collect_list("node")).alias("sources")).crossJoin(targets.agg(F.array_sort(F.collect_list("node")).alias("targets"))).withColumn("query_id", F.lit(0).cast("long"))
        chosen = materialize(heuristic(edges, queries, k, r, "rel", worlds, hops), "colors")
        rows = found.select(F.lit(turn).alias("round"), F.lit("seed").alias("kind"), "rank", F.col("node").alias("id"), "hits")
        rows = rows.unionByName(chosen.select(F.lit(turn).alias("round"), F.lit("color").alias("kind"), F.col("rank").cast("int").alias("rank"), F.col("color").alias("id"), "hits"))
        out = rows if out is None else out.unionByName(rows)
    return out
