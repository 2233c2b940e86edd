"""Uncertain edge-labelled graphs as edge tables: src, dst, color and a probability, p or, in whole percent, p_pct.

Edges that share src, dst and color are told apart by edge_id; a table without it has one edge for each of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.functions.coins import edge_key
from fogline.functions.costs import chance, cost
from fogline.functions.runtime import materialize, ranked, small

#: Color of edges that every selection may use.
NEUTRAL = -1
#: Ids of the nodes that stand for all sources and all targets.
SUPER_SOURCE, SUPER_SINK = -1, -2
#: What operators know of an edge.
EDGE = ["edge_id", "src", "dst", "color", "p", "coin"]


def nodes(edges: DataFrame) -> DataFrame:
    """The distinct node ids."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def colors(edges: DataFrame) -> DataFrame:
    """The distinct colors but NEUTRAL."""
    return edges.where(F.col("color") != NEUTRAL).select("color").distinct()


def swapped(edges: DataFrame) -> DataFrame:
    """The edges with their ends exchanged."""
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def bidirected(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse."""
    return edges.unionByName(swapped(edges))


def identified(edges: DataFrame, directed: bool = True) -> DataFrame:
    """The arcs of a graph as (edge_id, src, dst, color, p, coin), written once; both arcs of an undirected edge share id and coin.

    Without edge ids, an edge's id is its place in the order of the edges' printed forms; of rows that share src, dst and color the
    one with the largest p counts, as they would share their coins too. ``coin`` names the edge in its coins. A table that has
    ``coin`` is identified already and stays as it is.
    """
    if "coin" in edges.columns:
        return edges
    coin = edge_key(edges.columns, directed).alias("coin")
    if "edge_id" in edges.columns:
        rows = edges.select(F.col("edge_id").cast("long").alias("edge_id"), "src", "dst", "color", chance(edges.columns).alias("p"), coin)
    else:
        rows = edges.select("src", "dst", "color", chance(edges.columns).alias("p"), coin).groupBy("src", "dst", "color", "coin").agg(F.max("p").alias("p"))
        rows = ranked(rows.withColumn("label", edge_label()), "label", "edge_id").select(*EDGE)
    return materialize(rows if directed else bidirected(rows), "edges")


def printed(edges: DataFrame) -> DataFrame:
    """(edge_id, label) of a graph as it was given: src>dst#color, and @edge_id where the table has edge ids."""
    label = edge_label()
    if "coin" not in edges.columns:
        label = F.concat(label, F.lit("@"), F.col("edge_id").cast("string")) if "edge_id" in edges.columns else label
        edges = edges if "edge_id" in edges.columns else identified(edges)
    else:
        label = F.concat(label, F.when(F.contains("coin", F.lit("@")), F.concat(F.lit("@"), F.col("edge_id").cast("string"))).otherwise(F.lit("")))
    return edges.select("edge_id", label.alias("label")).groupBy("edge_id").agg(F.min("label").alias("label"))


def with_paths(walks: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``walks`` (keys, edges) with ``path``, the printed edges in order, with | between; empty for none."""
    each = walks.select(*keys, F.posexplode("edges").alias("at", "edge_id")).join(printed(edges), "edge_id")
    told = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("steps"))
    path = F.array_join(F.transform("steps", lambda x: x["label"]), "|")
    return walks.join(told.select(*keys, path.alias("path")), keys, "left").withColumn("path", F.coalesce("path", F.lit("")))


def extended(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, src, dst, color, p or p_pct) of the super edges and, with query_id null, the graph's own edges.

    Super edges are certain, neutral and lead from SUPER_SOURCE to each source and from each target to SUPER_SINK.
    """
    p, certain = ("p", 1.0) if "p" in edges.columns else ("p_pct", 100)
    to = queries.select("query_id", F.lit(SUPER_SOURCE).cast("long").alias("src"), F.explode("sources").alias("dst"))
    off = queries.select("query_id", F.explode("targets").alias("src"), F.lit(SUPER_SINK).cast("long").alias("dst"))
    extra = to.unionByName(off).withColumns({"color": F.lit(NEUTRAL).cast("long"), p: F.lit(certain).cast(edges.schema[p].dataType)})
    return extra.unionByName(edges.select(F.lit(None).cast("long").alias("query_id"), "src", "dst", "color", p))


def with_cost(edges: DataFrame) -> DataFrame:
    """Edges with a probability above 0 and their cost."""
    p = chance(edges.columns)
    return edges.where(p > 0).withColumn("cost", cost(p))


def of_colors(edges: DataFrame, chosen: DataFrame, neutral: bool = True) -> DataFrame:
    """Edges whose color is in ``chosen`` (color), and neutral ones unless told otherwise."""
    kept = edges.join(small(chosen.select("color").distinct()), "color", "left_semi").select(edges.columns)
    return kept.unionByName(edges.where(F.col("color") == NEUTRAL)) if neutral else kept


def unknown_queries(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """The query_id of queries that name a node without edges."""
    named = queries.select("query_id", F.explode(F.concat("sources", "targets")).alias("node"))
    return named.join(nodes(edges), "node", "left_anti").select("query_id").distinct()


def valid_queries(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """Queries whose nodes all have edges."""
    return queries.join(unknown_queries(queries, edges), "query_id", "left_anti")


def require_colors(edges: DataFrame, k: int) -> None:
    """Raise if the graph has fewer than ``k`` colors."""
    found = colors(edges).count()
    if found < k:
        raise ValueError(f"{k} colors asked for, the graph has {found}")


def first_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (src, dst) of ``pairs`` the edge with the smallest color, and the smallest probability among those."""
    p = "p" if "p" in edges.columns else "p_pct"
    return edges.join(pairs, ["src", "dst"]).groupBy("src", "dst").agg(F.min(F.struct("color", p)).alias("e")).select("src", "dst", "e.color", f"e.{p}")


def deduplicated(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, color), with the largest probability."""
    p = "p" if "p" in edges.columns else "p_pct"
    return edges.groupBy("src", "dst", "color").agg(F.max(p).alias(p))


def edge_label(src="src", dst="dst", color="color"):
    """The printed form of an edge, src>dst#color."""
    return F.concat(F.col(src).cast("string"), F.lit(">"), F.col(dst).cast("string"), F.lit("#"), F.col(color).cast("string"))


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, path_id, position, edge_id, src, dst, color, p, coin) of paths given as (query_id, path_id, edges), by edge ids.

    An undirected edge that was identified as such gives both of its arcs at its position.
    """
    each = paths.select("query_id", "path_id", F.posexplode("edges").alias("position", "edge_id"))
    return each.join(identified(edges), "edge_id").select("query_id", "path_id", "position", *EDGE)


def path_colors(walked: DataFrame) -> DataFrame:
    """(query_id, path_id, colors): the distinct colors but NEUTRAL, ascending."""
    return walked.groupBy("query_id", "path_id").agg(F.array_sort(F.collect_set(F.when(F.col("color") != NEUTRAL, F.col("color")))).alias("colors"))


def path_ends(walked: DataFrame) -> DataFrame:
    """(query_id, path_id, first, last): the source of the first edge and the target of the last."""
    return walked.groupBy("query_id", "path_id").agg(F.min_by("src", "position").alias("first"), F.max_by("dst", "position").alias("last"))
