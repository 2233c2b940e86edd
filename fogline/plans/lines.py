"""From text to text: graph and query lines in, lines with the colors of each query, or their evaluation, out."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.functions.runtime import materialize
from fogline.operators import graph, objectives, select
from fogline.sources import graph_text, sinks

STRATEGIES = ("h", "b1", "b2")


def colors_of_lines(graph_lines: DataFrame, query_lines: DataFrame, k: int, objective: str = "s", strategy: str = "h", r: int = 10, worlds: int = 1000, directed: bool = True, seconds: int | None = None) -> DataFrame:
    """A result line (value) for each query line `S;T` whose nodes the graph `u v p1 c1 ...` has: its k colors, how many of them were
    found before unused ones filled up the rest, the samples, and the seconds that it took unless they are given.

    Equal query lines are answered once; queries with unknown nodes are left out (``graph.unknown_queries`` names them); a graph of fewer
    than k colors is an error. Probabilities count as they are written.
    """
    if objective not in objectives.OBJECTIVES or strategy not in STRATEGIES:
        raise ValueError(f"objective {objective!r} or strategy {strategy!r} is unknown")
    began = time.time()
    edges = graph.identified(graph_text.wide_graph(graph_lines), directed)
    graph.require_colors(edges, k)
    parsed = graph_text.queries(query_lines).distinct()
    asked = parsed.withColumn("line", F.concat_ws(";", F.array_join(F.transform("sources", lambda x: x.cast("string")), " "), F.array_join(F.transform("targets", lambda x: x.cast("string")), " ")))
    asked = graph_text.numbered(asked, "line").select("query_id", "sources", "targets")
    asked = materialize(graph.valid_queries(asked, edges), "asked")
    if strategy == "h":
        found = select.heuristic(edges, asked, k, r, objective, worlds)
    else:
        found = (objectives.baseline1 if strategy == "b1" else objectives.baseline2)(edges, asked, k, objective, worlds)
    found = materialize(found, "found")
    filled = objectives.fill(found, asked, graph.colors(edges), k)
    told = filled.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "color"))).alias("by_rank"))
    told = told.select("query_id", F.transform("by_rank", lambda x: x["color"]).alias("colors"))
    n = found.groupBy("query_id").agg(F.count("*").alias("found"))
    took = F.lit(round(time.time() - began) if seconds is None else seconds)
    out = asked.join(told, "query_id").join(n, "query_id", "left").fillna(0, ["found"])
    return sinks.result_lines(out.withColumns({"loops": F.lit(worlds), "seconds": took}))


def evaluation_of_lines(graph_lines: DataFrame, result_lines: DataFrame, objective: str = "s", worlds: int = 50, directed: bool = True, seconds: int | None = None) -> DataFrame:
    """Each result line `S;T; colors; ...` (value) with the evaluation of its colors; equal lines are evaluated once."""
    began = time.time()
    edges = graph.identified(graph_text.wide_graph(graph_lines), directed)
    numbered = materialize(graph_text.numbered(result_lines.select("value").distinct().where(F.trim("value") != ""), "value"), "results")
    parsed = materialize(numbered.select("query_id", F.col("value").alias("line")).join(graph_text.results(numbered, "query_id"), "query_id"), "parsed")
    hits = objectives.evaluate(edges, parsed.select("query_id", "sources", "targets"), parsed.select("query_id", F.explode("colors").alias("color")), objective, worlds)
    hits = materialize(hits, "hits")
    took = F.lit(round(time.time() - began) if seconds is None else seconds)
    return sinks.eval_lines(parsed.join(hits, "query_id").select("line", F.col("hits").alias("metric"), "worlds", took.alias("seconds")))
