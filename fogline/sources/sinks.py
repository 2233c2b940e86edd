"""Text forms of results, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.functions.costs import chance, cost


def _ids(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def wide_lines(edges: DataFrame) -> DataFrame:
    """(src, dst, p, color) to `u v p1 c1 ...`, one line an endpoint pair, colors ascending."""
    pairs = F.array_sort(F.collect_list(F.struct("color", "p")))
    told = F.array_join(F.transform(pairs, lambda x: F.concat(x["p"].cast("string"), F.lit(" "), x["color"].cast("string"))), " ")
    return edges.groupBy("src", "dst").agg(told.alias("t")).select(F.concat_ws(" ", "src", "dst", "t").alias("value"))


def long_lines(edges: DataFrame) -> DataFrame:
    """(src, dst, p, color) to `u v p c`."""
    return edges.select(F.concat_ws(" ", "src", "dst", F.col("p").cast("string"), "color").alias("value"))


def collapsed_lines(edges: DataFrame) -> DataFrame:
    """(src, dst, p) to `u v p`."""
    return edges.select(F.concat_ws(" ", "src", "dst", F.col("p").cast("string")).alias("value"))


def result_lines(found: DataFrame) -> DataFrame:
    """(sources, targets, colors, found, loops, seconds) to `S;T; colors; found; Loop: n; Time: t`."""
    line = F.concat(_ids(F.col("sources")), F.lit(";"), _ids(F.col("targets")), F.lit("; "), _ids(F.col("colors")), F.lit("; "), F.col("found").cast("string"), F.lit("; Loop: "), F.col("loops").cast("string"), F.lit("; Time: "), F.col("seconds").cast("string"))
    return found.select(line.alias("value"))


def eval_lines(found: DataFrame) -> DataFrame:
    """(line, metric, worlds, seconds) to `line; Eval: m n; Evaltime: t`."""
    return found.select(F.concat("line", F.lit("; Eval: "), F.col("metric").cast("string"), F.lit(" "), F.col("worlds").cast("string"), F.lit("; Evaltime: "), F.col("seconds").cast("string")).alias("value"))


def seed_lines(seeds: DataFrame) -> DataFrame:
    """(rank, node, hits, worlds) to `rank node spread`."""
    return seeds.select(F.concat_ws(" ", "rank", "node", (F.col("hits") / F.col("worlds")).cast("string")).alias("value"))


def path_lines(walked: DataFrame) -> DataFrame:
    """(query_id, path_id, value) of walked edges (query_id, path_id, position, src, dst, color, p): `1-(c:2,cost:105)->3 path-cost: 105`."""
    step = F.concat(F.lit("-(c:"), F.col("color").cast("string"), F.lit(",cost:"), cost(F.col("p")).cast("string"), F.lit(")->"), F.col("dst").cast("string"))
    steps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", step.alias("step")))), lambda x: x["step"]), "")
    found = walked.groupBy("query_id", "path_id").agg(F.min_by("src", "position").alias("first"), steps.alias("steps"), F.sum(cost(F.col("p"))).alias("total"))
    return found.select("query_id", "path_id", F.concat(F.col("first").cast("string"), "steps", F.lit(" path-cost: "), F.col("total").cast("string")).alias("value"))


def path_set_lines(walked: DataFrame) -> DataFrame:
    """(query_id, value): the printed paths of each query, `{...} {...}` in the order of path_id."""
    each = F.array_sort(F.collect_list(F.struct("path_id", "value")))
    printed = F.array_join(F.transform(each, lambda x: F.concat(F.lit("{"), x["value"], F.lit("}"))), " ")
    return path_lines(walked).groupBy("query_id").agg(printed.alias("value"))


def graph_lines(edges: DataFrame) -> DataFrame:
    """The edges of a graph, one a line: `1-(c:2,cost:105)->3`; an edge that never exists has no cost."""
    p = chance(edges.columns)
    told = F.coalesce(F.when(p > 0, cost(p)).cast("string"), F.lit("none"))
    return edges.select(F.concat(F.col("src").cast("string"), F.lit("-(c:"), F.col("color").cast("string"), F.lit(",cost:"), told, F.lit(")->"), F.col("dst").cast("string")).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    """Write the column ``value`` as text."""
    df.select("value").write.text(path)


def append_statistics(df: DataFrame, path: str) -> None:
    """Append the rows of a run to a Parquet table."""
    df.write.mode("append").parquet(path)
