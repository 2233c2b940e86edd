"""Cheapest trees that join all terminals of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fogline.functions.runtime import Rounds, materialize
from fogline.operators.graph import identified, with_cost

#: Terminals of a query at most; a mask is a BIGINT.
MAX_TERMINALS = 32


def tree_states(edges: DataFrame, terminals: DataFrame, directed: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """(query_id, node, mask, cost, edges): the cheapest tree from each set of terminals to each root, its edges by id.

    ``terminals`` is (query_id, node). Rounds grow trees over one edge and merge trees of disjoint sets at a root, starting
    from those that improved, until none does; among equal costs the smaller list of edge ids wins. Parallel edges are edges of
    their own.
    """
    arcs = materialize(with_cost(identified(edges, directed)).select(F.col("src").alias("node"), "dst", F.col("cost").alias("step"), F.col("edge_id").alias("edge")), "arcs")
    numbered = terminals.select("query_id", "node").distinct().withColumn("bit", F.row_number().over(W.partitionBy("query_id").orderBy("node")) - 1)
    none = F.array().cast("array<bigint>")
    rounds = Rounds("trees")
    state = rounds.write(numbered.select("query_id", "node", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")).alias("mask"), F.lit(0).cast("long").alias("cost"), none.alias("edges"), F.lit(True).alias("fresh")))
    if state.groupBy("query_id").count().where(F.col("count") > MAX_TERMINALS).limit(1).count():
        raise ValueError(f"more than {MAX_TERMINALS} terminals")
    for _ in range(max_rounds):
        fresh = state.where("fresh")
        grown = fresh.join(arcs, "node").select("query_id", F.col("dst").alias("node"), "mask", (F.col("cost") + F.col("step")).alias("cost"), F.array_sort(F.array_union("edges", F.array("edge"))).alias("edges"))
        other = state.select("query_id", "node", F.col("mask").alias("mask2"), F.col("cost").alias("cost2"), F.col("edges").alias("edges2"))
        merged = fresh.join(other, ["query_id", "node"]).where(F.col("mask").bitwiseAND(F.col("mask2")) == 0)
        merged = merged.select("query_id", "node", F.col("mask").bitwiseOR(F.col("mask2")).alias("mask"), (F.col("cost") + F.col("cost2")).alias("cost"), F.array_sort(F.array_union("edges", "edges2")).alias("edges"))
        new = state.drop("fresh").withColumn("new", F.lit(0)).unionByName(grown.unionByName(merged).withColumn("new", F.lit(1)))
        best = new.groupBy("query_id", "node", "mask").agg(F.min(F.struct("cost", "edges")).alias("b"), F.min(F.when(F.col("new") == 0, F.col("cost"))).alias("old"))
        best = best.select("query_id", "node", "mask", "b.cost", "b.edges", (F.col("old").isNull() | (F.col("b.cost") < F.col("old"))).alias("fresh"))
        state = rounds.write(best, F.col("fresh"))
        if rounds.watched == 0:
            return state.drop("fresh")
    raise RuntimeError(f"trees still improve after {max_rounds} rounds")


def top_trees(edges: DataFrame, terminals: DataFrame, r: int, directed: bool = True) -> DataFrame:
    """(query_id, rank, root, cost, edges): the r cheapest trees over all terminals, one a root, equal edge sets once."""
    full = terminals.select("query_id", "node").distinct().groupBy("query_id").agg((F.call_function("shiftleft", F.lit(1).cast("long"), F.count("*").cast("int")) - 1).alias("mask"))
    trees = tree_states(edges, terminals, directed).join(full, ["query_id", "mask"])
    trees = trees.groupBy("query_id", "edges").agg(F.min(F.struct("cost", "node")).alias("b"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("b.cost", "b.node"))
    return trees.withColumn("rank", rank).where(F.col("rank") <= r).select("query_id", "rank", F.col("b.node").alias("root"), "b.cost", "edges")
