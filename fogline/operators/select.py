"""Greedy choice of colors along reliable walks or trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fogline.functions.coins import toss
from fogline.functions.runtime import Rounds, materialize
from fogline.operators import objectives as obj
from fogline.operators.graph import EDGE, NEUTRAL, identified, path_edges
from fogline.operators.paths import walk_edges
from fogline.operators.reach import hits_at, reach, start, worlds_of_all, worlds_of_any
from fogline.operators.steiner import top_trees

KEYS = ["query_id", "cand"]


def ordered_colors(walked: DataFrame) -> DataFrame:
    """(query_id, path_id, colors): distinct colors but NEUTRAL in the order of the path."""
    steps = F.array_sort(F.collect_list(F.struct("position", "color")))
    told = F.array_distinct(F.transform(F.filter(steps, lambda x: x["color"] != NEUTRAL), lambda x: x["color"]))
    return walked.groupBy("query_id", "path_id").agg(told.alias("colors"))


def _masks(edges: DataFrame, worlds: int) -> DataFrame:
    """(keys, src, dst, color, chunk, em) of edges (keys, EDGE): coins depend on the edge alone, so all candidates see the same worlds,
    and each edge is tossed once for all of them."""
    tossed = toss(edges.select("edge_id", "coin", "p").distinct(), worlds, ["edge_id"], F.col("coin"), F.col("p"))
    return edges.join(tossed, "edge_id").drop("edge_id", "coin", "p")


def _scored(edges: DataFrame, queries: DataFrame, cands: DataFrame, objective: str, worlds: int) -> DataFrame:
    """(query_id, cand, hits) where each candidate has edges of its own."""
    masks = materialize(_masks(edges, worlds), "own-masks")
    if objective == "conn":
        ends = queries.select("query_id", F.explode(F.array_union("sources", "targets")).alias("node")).distinct()
        seeds = ends.join(cands, "query_id").select(*KEYS, F.col("node").alias("root"), "node")
        reached = reach(masks, start(seeds, worlds), [*KEYS, "root"], edge_keys=KEYS, until_all=ends)
        got = worlds_of_all(reached, ends, [*KEYS, "root"]).groupBy(*KEYS).agg(F.max("hits").alias("hits"))
    else:
        seeds = queries.join(cands, "query_id").select(*KEYS, F.explode("sources").alias("node"))
        at = queries.select("query_id", F.explode("targets").alias("node")).distinct()
        until = {"until_all": at} if objective == "rel" else {"until_any": at}
        reached = reach(masks, start(seeds, worlds), KEYS, edge_keys=KEYS, **until)
        got = hits_at(reached, at, KEYS).groupBy(*KEYS).agg(F.sum("hits").alias("hits")) if objective == "rel" else worlds_of_any(reached, at, KEYS)
    return cands.join(got, KEYS, "left").select(*KEYS, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def greedy(walked: DataFrame, queries: DataFrame, k: int, objective: str, worlds: int) -> DataFrame:
    """(query_id, rank, color, hits) chosen along paths or trees ``walked`` (query_id, path_id, position, EDGE).

    Each round folds in what needs no new color, drops what would need more than k colors, scores each remaining path
    together with all that was folded in, and takes the best (the earlier path among equals) with its new colors in path
    order. All candidates of all queries are one job a round; there are k rounds at most. ``hits`` is the score when a color was
    chosen; for those chosen last it is the score of all that is folded in at the end.
    """
    walked = materialize(walked, "walked")
    rest = materialize(ordered_colors(walked).withColumn("chosen", F.array().cast("array<bigint>")), "rest")
    taken = rest.select("query_id", "path_id").limit(0)
    out = None
    for turn in range(k + 1):
        state = rest.withColumn("new", F.array_except("colors", "chosen"))
        folded = state.where(F.size("new") == 0).select("query_id", "path_id")
        taken = materialize(taken.unionByName(folded), "taken")
        state = materialize(state.where((F.size("new") > 0) & (F.size("chosen") + F.size("new") <= k)), "state")
        if turn == k or state.limit(1).count() == 0:
            break
        cands = state.select("query_id", F.col("path_id").alias("cand"))
        base = _own(walked, taken)
        own = walked.join(cands.withColumnRenamed("cand", "path_id"), ["query_id", "path_id"], "left_semi").select("query_id", F.col("path_id").alias("cand"), *EDGE)
        edges = base.join(cands, "query_id").select("query_id", "cand", *EDGE).unionByName(own).distinct()
        scores = _scored(edges, queries, cands, objective, worlds)
        best = scores.groupBy("query_id").agg(F.max(F.struct("hits", (-F.col("cand")).alias("minus"))).alias("b")).select("query_id", (-F.col("b.minus")).alias("best"), F.col("b.hits").alias("hits"))
        picked = materialize(state.join(best, "query_id").where("path_id = best").select("query_id", "path_id", "new", "chosen", "hits"), "picked")
        added = picked.select("query_id", F.lit(turn).alias("turn"), F.posexplode("new").alias("i", "color"), F.size("chosen").alias("have"), "hits").select("query_id", "turn", (F.col("have") + F.col("i") + 1).alias("rank"), "color", "hits")
        out = added if out is None else out.unionByName(added)
        taken = taken.unionByName(picked.select("query_id", "path_id"))
        grown = picked.select("query_id", F.col("path_id").alias("gone"), F.concat("chosen", "new").alias("chosen"))
        rest = materialize(state.drop("chosen", "new").join(grown, "query_id").where("path_id != gone").drop("gone"), "rest")
    if out is None:
        return walked.select("query_id", F.lit(0).alias("rank"), "color", F.lit(0).cast("long").alias("hits")).limit(0)
    out = materialize(out, "chosen")
    cands = out.select("query_id", F.lit(0).cast("long").alias("cand")).distinct()
    final = _own(walked, taken).join(cands, "query_id").select(*KEYS, *EDGE)
    final = _scored(final, queries, cands, objective, worlds).select("query_id", F.col("hits").alias("final"))
    last = out.groupBy("query_id").agg(F.max("turn").alias("last"))
    hits = F.when(F.col("turn") == F.col("last"), F.col("final")).otherwise(F.col("hits")).alias("hits")
    return out.join(last, "query_id").join(final, "query_id").select("query_id", "rank", "color", hits)


def _own(walked: DataFrame, taken: DataFrame) -> DataFrame:
    """(query_id, EDGE) of the paths ``taken``, each edge once."""
    return walked.join(taken, ["query_id", "path_id"], "left_semi").select("query_id", *EDGE).distinct()


def _walked(walks: DataFrame, edges: DataFrame) -> DataFrame:
    return path_edges(walks.withColumn("path_id", F.col("rank").cast("long")), edges)


def heuristic(edges: DataFrame, queries: DataFrame, k: int, r: int, objective: str, worlds: int = 64, hops: int | None = None, directed: bool = True) -> DataFrame:
    """The k colors by the r most reliable walks (conn: trees), of ``hops`` edges at most if given: (query_id, rank, color, hits)."""
    graph = identified(edges, directed)
    if objective == "conn":
        terminals = queries.select("query_id", F.explode(F.array_union("sources", "targets")).alias("node"))
        trees = top_trees(graph, terminals, r)
        return greedy(_walked(trees.select("query_id", "rank", "edges").where(F.size("edges") > 0), graph), queries, k, "conn", worlds)
    if objective == "max":
        solved = materialize(obj.by_pair(queries), "pairs")
        found = materialize(heuristic(graph, solved.select("query_id", "sources", "targets"), k, r, "sum", worlds, hops), "h")
        return obj._best_pair(found, solved, F.max("hits"))
    if objective == "min":
        return max_min(graph, queries, k, r, worlds, hops)
    if objective == "s":
        queries, objective = obj._single(queries), "sum"
    if objective == "avg":
        # the walks of all pairs of a query are pooled
        solved = materialize(obj.by_pair(queries), "pairs")
        walks = walk_edges(graph, solved.select("query_id", "sources", "targets"), r, hops)
        pooled = walks.join(solved.select("query_id", "parent"), "query_id").select(F.col("parent").alias("query_id"), "cost", "edges").distinct()
        pooled = pooled.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("cost", "edges")))
        return greedy(_walked(pooled, graph), queries, k, "sum", worlds)
    return greedy(_walked(walk_edges(graph, queries, r, hops), graph), queries, k, objective, worlds)


def minimum_cover(routes: DataFrame, k: int, max_rounds: int = 100_000) -> DataFrame:
    """(query_id, color): colors that leave each pair a path with none but these, by few additions; none for a query that k don't do for.

    ``routes`` has (query_id, pair, rank, colors). Of the paths of pairs that aren't done, the one that needs the fewest new colors is
    next, then the one of the least rank, then of the least pair, and its pair is done. Over k colors, the smallest color goes without
    which every pair done keeps a path and which the new path doesn't need. Each round takes a path or drops a color, for all queries
    at once.
    """
    routes = materialize(routes.select("query_id", "pair", "rank", "colors"), "routes")
    pairs = routes.groupBy("query_id").agg(F.count_distinct("pair").alias("n"))
    none = F.array().cast("array<bigint>")
    states, dones = Rounds("cover"), Rounds("done")
    state = states.write(pairs.select("query_id", "n", F.lit(0).cast("long").alias("n_done"), none.alias("chosen"), F.lit(None).cast(routes.schema["pair"].dataType).alias("pend"), none.alias("needs"), F.lit(False).alias("dead")), F.lit(True))
    done = dones.write(routes.select("query_id", "pair").limit(0))
    for _ in range(max_rounds):
        if states.watched == 0:
            return state.where("not dead and n_done = n").select("query_id", F.explode(F.array_sort("chosen")).alias("color"))
        # queries that take a path
        left = routes.join(done, ["query_id", "pair"], "left_anti").join(state.where("pend is null and not dead and n_done < n").select("query_id", "chosen"), "query_id")
        cost = F.size(F.array_except("colors", "chosen")).alias("cost")
        taken = left.groupBy("query_id").agg(F.min(F.struct(cost, "rank", "pair", "colors")).alias("t")).select("query_id", "t.pair", "t.colors")
        # queries that drop a color: those without which every pair done has a path
        over = state.where("pend is not null and not dead")
        spare = over.select("query_id", "chosen", "n_done", F.explode(F.array_except("chosen", "needs")).alias("c"))
        kept = routes.join(done, ["query_id", "pair"]).join(spare, "query_id").where(F.size(F.array_except("colors", F.array_remove("chosen", F.col("c")))) == 0)
        fits = kept.select("query_id", "c", "n_done", "pair").distinct().groupBy("query_id", "c", "n_done").count().where("count = n_done").select("query_id", "c")
        fits = fits.unionByName(spare.where("n_done = 0").select("query_id", "c")).groupBy("query_id").agg(F.min("c").alias("c"))
        both = state.join(taken, "query_id", "left").join(fits, "query_id", "left")
        takes, drops = F.col("pair").isNotNull(), F.col("pend").isNotNull() & ~F.col("dead") & F.col("c").isNotNull()
        now = F.when(takes, F.array_union("chosen", "colors")).when(drops, F.array_remove("chosen", F.col("c"))).otherwise(F.col("chosen"))
        moved = both.select("query_id", "n", "n_done", now.alias("chosen"), F.coalesce("pair", "pend").alias("at"), F.coalesce("colors", "needs").alias("needs"), (F.col("dead") | (F.col("pend").isNotNull() & F.col("c").isNull())).alias("dead"), (takes | drops).alias("moved"))
        moved = materialize(moved.withColumn("fits", F.col("moved") & (F.size("chosen") <= k)), "moved")
        done = dones.write(done.unionByName(moved.where("fits").select("query_id", F.col("at").alias("pair"))))
        state = moved.select("query_id", "n", (F.col("n_done") + F.col("fits").cast("long")).alias("n_done"), "chosen", F.when(~F.col("fits") & F.col("at").isNotNull() & (F.size("chosen") > k), F.col("at")).alias("pend"), "needs", "dead")
        state = states.write(state, ~F.col("dead") & (F.col("n_done") < F.col("n")))
    raise RuntimeError(f"covers are open after {max_rounds} rounds")


def max_min(edges: DataFrame, queries: DataFrame, k: int, r: int, worlds: int, hops: int | None) -> DataFrame:
    """Colors for the worst pair: a cover, then rounds that add the path of the worst pair that gains most, up to k colors.

    Colors come in ascending order. A query with a pair that no walk joins gets none.
    """
    edges, solved = identified(edges), materialize(obj.by_pair(queries), "pairs")
    walks = walk_edges(edges, solved.select("query_id", "sources", "targets"), r, hops)
    walked = materialize(_walked(walks, edges).withColumnRenamed("query_id", "pair"), "walked")
    told = ordered_colors(walked.withColumnRenamed("pair", "query_id")).withColumnsRenamed({"query_id": "pair", "path_id": "rank"})
    routes = materialize(told.join(solved.select(F.col("query_id").alias("pair"), F.col("parent").alias("query_id"), "place"), "pair"), "routes")
    whole = solved.join(routes.select(F.col("pair").alias("query_id")).distinct(), "query_id", "left_anti").select(F.col("parent").alias("query_id")).distinct()
    routes = materialize(routes.join(whole, "query_id", "left_anti"), "routes")
    chosen = materialize(minimum_cover(routes.withColumn("pair", F.col("place")), k), "cover")
    ends = solved.select(F.col("query_id").alias("pair"), F.col("parent").alias("query_id"), "source", "target", "place")

    def pair_hits(cands: DataFrame, allowed: DataFrame) -> DataFrame:
        """(query_id, cand, pair, hits) of candidates (query_id, cand, pair) with colors (query_id, cand, color), each within its pair's paths."""
        own = walked.select("pair", *EDGE).distinct().join(cands, "pair").join(allowed, ["query_id", "cand", "color"])
        keys = ["query_id", "cand", "pair"]
        masks = materialize(_masks(own.select(*keys, *EDGE), worlds), "pair-masks")
        seeds = cands.join(ends, ["query_id", "pair"]).select(*keys, F.col("source").alias("node"))
        at = ends.select("query_id", "pair", F.col("target").alias("node"))
        reached = reach(masks, start(seeds, worlds), keys, edge_keys=keys, until_any=at)
        got = hits_at(reached, at, keys).select(*keys, "hits")
        return cands.join(got, keys, "left").select(*keys, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))

    zero = F.lit(0).cast("long").alias("cand")
    for _ in range(k):
        sets = chosen.groupBy("query_id").agg(F.collect_set("color").alias("have")).where(F.size("have") < k)
        now = materialize(routes.join(sets, "query_id"), "open")
        if now.limit(1).count() == 0:
            break
        base = materialize(pair_hits(now.select("query_id", zero, "pair").distinct(), chosen.select("query_id", zero, "color")), "base")
        worst = base.join(ends.select("query_id", "pair", "place"), ["query_id", "pair"]).groupBy("query_id").agg(F.min(F.struct("hits", "place", "pair")).alias("w")).select("query_id", F.col("w.pair").alias("pair"))
        options = now.join(worst, ["query_id", "pair"]).withColumn("new", F.array_except("colors", "have")).where((F.size("new") > 0) & (F.size("have") + F.size("new") <= k))
        options = materialize(options.withColumn("cand", F.col("rank")), "options")
        if options.limit(1).count() == 0:
            break
        allowed = options.select("query_id", "cand", F.explode(F.array_union("have", "colors")).alias("color"))
        gains = pair_hits(options.select("query_id", "cand", "pair"), allowed)
        best = gains.groupBy("query_id").agg(F.max(F.struct("hits", (-F.col("cand")).alias("minus"))).alias("b")).select("query_id", (-F.col("b.minus")).alias("cand"))
        added = options.join(best, ["query_id", "cand"]).select("query_id", F.explode("new").alias("color"))
        chosen = materialize(chosen.unionByName(added), "chosen")
    cands = chosen.select("query_id").distinct().withColumn("cand", F.lit(0).cast("long"))
    every = pair_hits(cands.join(ends.select("query_id", "pair"), "query_id"), chosen.select("query_id", zero, "color"))
    hits = every.groupBy("query_id").agg(F.min("hits").alias("hits"))
    return chosen.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("color"))).join(hits, "query_id").select("query_id", "rank", "color", "hits")

