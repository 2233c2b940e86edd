"""Objectives of a color set, and the strategies that choose one: evaluation, two baselines and path-based heuristics.

Queries are (query_id, sources, targets). Candidates are keyed (query_id, cand); ``allowed`` is (query_id, cand, color).
Scores are whole numbers of hits out of ``worlds`` (times pairs or targets for avg and rel).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fogline.functions.runtime import materialize
from fogline.operators.graph import colors
from fogline.operators.reach import edge_masks, hits_at, reach, start, worlds_of_all, worlds_of_any

OBJECTIVES = ("s", "sum", "avg", "max", "min", "rel", "conn")
KEYS = ["query_id", "cand"]


def pairs(queries: DataFrame) -> DataFrame:
    """(query_id, source, target) of all pairs of a query with different ends."""
    return queries.select("query_id", F.explode("sources").alias("source"), "targets").select("query_id", "source", F.explode("targets").alias("target")).where("source != target")


def _single(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.array(F.array_min("sources")).alias("sources"), F.array(F.array_min("targets")).alias("targets"))


def score(masks: DataFrame, queries: DataFrame, cands: DataFrame, allowed: DataFrame, objective: str, worlds: int) -> DataFrame:
    """(query_id, cand, hits) for all candidates (query_id, cand) of all queries in one fixpoint; 0 where nothing is reached."""
    return _scored(_reached(masks, queries, cands, allowed, objective, worlds), queries, cands, objective)


def _root(objective: str) -> list[str]:
    """What reach is keyed by besides the candidate."""
    return [] if objective in ("sum", "rel") else ["root"] if objective == "conn" else ["source"]


def _nodes_to_hit(queries: DataFrame, objective: str) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_union("sources", "targets") if objective == "conn" else F.col("targets")).alias("node")).distinct()


def _reached(masks: DataFrame, queries: DataFrame, cands: DataFrame, allowed: DataFrame, objective: str, worlds: int, begun: DataFrame | None = None) -> DataFrame:
    """Reach of all candidates, up to where worlds are decided: (query_id, cand, root or source, chunk, node, mask).

    ``begun`` has such rows to start from, for candidates that reach at least these.
    """
    if objective == "s":
        queries, objective = _single(queries), "max"
    at, root = _nodes_to_hit(queries, objective), _root(objective)
    if begun is None:
        seeds = at if objective == "conn" else queries.select("query_id", F.explode("sources").alias("node"))
        begun = start(seeds.join(cands, "query_id").select(*KEYS, *[F.col("node").alias(c) for c in root], "node"), worlds)
    until = {"until_any": at} if objective == "sum" else {"until_all": at}
    return reach(masks, begun, [*KEYS, *root], allowed, KEYS, **until)


def _scored(reached: DataFrame, queries: DataFrame, cands: DataFrame, objective: str) -> DataFrame:
    if objective == "s":
        queries, objective = _single(queries), "max"
    at = _nodes_to_hit(queries, objective)
    if objective == "sum":
        got = worlds_of_any(reached, at, KEYS)
    elif objective == "rel":
        got = hits_at(reached, at, KEYS).groupBy(*KEYS).agg(F.sum("hits").alias("hits"))
    elif objective == "conn":
        got = worlds_of_all(reached, at, [*KEYS, "root"]).groupBy(*KEYS).agg(F.max("hits").alias("hits"))
    else:
        how = {"max": F.max("hits"), "min": F.min("hits"), "avg": F.sum("hits")}[objective]
        got = pair_scores(reached, queries, cands).groupBy(*KEYS).agg(how.alias("hits"))
    return cands.join(got, KEYS, "left").select(*KEYS, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def pair_scores(reached: DataFrame, queries: DataFrame, cands: DataFrame) -> DataFrame:
    """(query_id, cand, source, target, hits) of every pair, from reach keyed by source."""
    found = reached.groupBy(*KEYS, "source", F.col("node").alias("target")).agg(F.sum(F.bit_count("mask")).alias("hits"))
    wanted = pairs(queries).join(cands, "query_id")
    return wanted.join(found, [*KEYS, "source", "target"], "left").select(*KEYS, "source", "target", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def evaluate(edges: DataFrame, queries: DataFrame, chosen: DataFrame, objective: str, worlds: int = 50, directed: bool = True, quantise: int | None = None) -> DataFrame:
    """(query_id, hits, worlds) of the colors ``chosen`` (query_id, color) of each query."""
    masks = edge_masks(edges, worlds, directed, quantise)
    cands = queries.select("query_id", F.lit(0).cast("long").alias("cand"))
    allowed = chosen.select("query_id", F.lit(0).cast("long").alias("cand"), "color")
    return score(masks, queries, cands, allowed, objective, worlds).select("query_id", "hits", F.lit(worlds).cast("long").alias("worlds"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Per query the k candidates with the most hits above 0, smaller candidates first among equals: (query_id, rank, color, hits)."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("hits").desc(), "cand"))
    return scores.where("hits > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("cand").alias("color"), "hits")


def by_pair(queries: DataFrame) -> DataFrame:
    """Each pair of a query as a query of its own: (query_id, sources, targets, parent, source, target, place), ``place`` being its number
    within the query by source and target."""
    each = pairs(queries).withColumn("parent", F.col("query_id"))
    each = each.withColumn("place", F.row_number().over(W.partitionBy("parent").orderBy("source", "target")).cast("long"))
    return each.withColumn("query_id", F.xxhash64("parent", "source", "target")).withColumns({"sources": F.array("source"), "targets": F.array("target")})


def _best_pair(found: DataFrame, solved: DataFrame, total) -> DataFrame:
    """The colors of each query's best pair; of equal pairs the later one, as its colors replace those found before."""
    worth = found.groupBy("query_id").agg(total.alias("worth")).join(solved.select("query_id", "parent", "source", "target"), "query_id")
    best = worth.groupBy("parent").agg(F.max_by("query_id", F.struct("worth", "source", "target")).alias("query_id"))
    return found.join(best, "query_id").select(F.col("parent").alias("query_id"), "rank", "color", "hits")


def baseline1(edges: DataFrame, queries: DataFrame, k: int, objective: str, worlds: int = 100, directed: bool = True, masks: DataFrame | None = None) -> DataFrame:
    """Each color by itself; the k best: (query_id, rank, color, hits). ``max`` solves each pair and keeps the best."""
    masks = edge_masks(edges, worlds, directed) if masks is None else masks
    if objective == "max":
        solved = materialize(by_pair(queries), "pairs")
        return _best_pair(materialize(baseline1(edges, solved.select("query_id", "sources", "targets"), k, "s", worlds, directed, masks), "b1"), solved, F.sum("hits"))
    cands = queries.select("query_id").crossJoin(colors(edges).select(F.col("color").alias("cand")))
    return top_k(score(masks, queries, cands, cands.withColumn("color", F.col("cand")), objective, worlds), k)


def baseline2(edges: DataFrame, queries: DataFrame, k: int, objective: str, worlds: int = 20, directed: bool = True, masks: DataFrame | None = None) -> DataFrame:
    """k rounds, each adding the color that scores best with those chosen: (query_id, rank, color, hits).

    One job a round for all colors of all queries. Among equal scores the smaller color is chosen. Colors only add to what is
    reached, so a round starts from the reach of the colors chosen so far, not from the sources.
    """
    masks = edge_masks(edges, worlds, directed) if masks is None else masks
    if objective == "max":
        solved = materialize(by_pair(queries), "pairs")
        return _best_pair(materialize(baseline2(edges, solved.select("query_id", "sources", "targets"), k, "s", worlds, directed, masks), "b2"), solved, F.max("hits"))
    every = materialize(colors(edges), "colors")
    chosen = begun = None
    for rank in range(1, k + 1):
        cands = queries.select("query_id").crossJoin(every.select(F.col("color").alias("cand")))
        if chosen is not None:
            cands = cands.join(chosen.select("query_id", F.col("color").alias("cand")), KEYS, "left_anti")
        cands = materialize(cands, "cands")
        allowed = cands.withColumn("color", F.col("cand"))
        if chosen is not None:
            allowed = allowed.unionByName(cands.join(chosen.select("query_id", "color"), "query_id"))
        if begun is not None:
            begun = begun.join(cands, "query_id")
        reached = _reached(masks, queries, cands, allowed, objective, worlds, begun)
        scores = _scored(reached, queries, cands, objective)
        best = scores.groupBy("query_id").agg(F.max(F.struct("hits", (-F.col("cand")).alias("minus"))).alias("b"))
        picked = materialize(best.select("query_id", F.lit(rank).alias("rank"), (-F.col("b.minus")).alias("color"), F.col("b.hits").alias("hits")), "picked")
        chosen = picked if chosen is None else materialize(chosen.unionByName(picked), "chosen")
        begun = reached.join(picked.select("query_id", F.col("color").alias("cand")), KEYS, "left_semi").drop("cand")
    return chosen


def fill(chosen: DataFrame, queries: DataFrame, every: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """Colors of each query filled up to k with unused ones in a seeded order: (query_id, rank, color)."""
    rest = queries.select("query_id").crossJoin(every.select("color")).join(chosen.select("query_id", "color"), ["query_id", "color"], "left_anti")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("color").cast("string")).cast("binary"))
    have = chosen.groupBy("query_id").agg(F.max("rank").alias("have"))
    more = rest.join(have, "query_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    more = more.withColumn("rank", (F.col("have") + F.row_number().over(W.partitionBy("query_id").orderBy(order, "color"))).cast("int"))
    return chosen.select("query_id", F.col("rank").cast("int").alias("rank"), "color").unionByName(more.where(F.col("rank") <= k).select("query_id", "rank", "color"))
