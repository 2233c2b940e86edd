"""Text forms of graphs, queries, results and dictionaries.

Every parser takes a DataFrame with a string column ``value``, one row a line, as ``spark.read.text`` gives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.functions.names import parse_ids
from fogline.functions.runtime import ranked
from fogline.operators.graph import bidirected


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file or folder."""
    return spark.read.text(path)


def _fields(df: DataFrame, separator: str = r"\s+") -> DataFrame:
    return df.where(F.trim("value") != "").select(F.split(F.trim("value"), separator).alias("f"))


def wide_graph(df: DataFrame, directed: bool = True) -> DataFrame:
    """`u v p1 c1 [p2 c2 ...]` to (src, dst, p, color), one row a pair. Loops give no edges; an undirected graph has both arcs."""
    f = F.col("f")
    rows = _fields(df).select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), F.explode(F.sequence(F.lit(2), F.size(f) - 2, F.lit(2))).alias("i"), "f")
    edges = rows.where("src != dst").select("src", "dst", F.get(f, F.col("i")).cast("double").alias("p"), F.get(f, F.col("i") + 1).cast("long").alias("color")).where("p > 0")
    return edges if directed else bidirected(edges)


def long_graph(df: DataFrame) -> DataFrame:
    """`u v p c` to (src, dst, p, color)."""
    f = F.col("f")
    return _fields(df).select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), f[2].cast("double").alias("p"), f[3].cast("long").alias("color"))


def collapsed_graph(df: DataFrame) -> DataFrame:
    """`u v p` to (src, dst, p, p_pct), the latter in truncated percent; operators take p, which is exact."""
    p = F.col("f")[2].cast("double")
    return _fields(df).select(F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst"), p.alias("p"), F.floor(F.round(p * 100, 6)).cast("long").alias("p_pct"))


def joined_endpoints(df: DataFrame) -> DataFrame:
    """`u_v ...` to (src, dst)."""
    f = F.col("f")
    return _fields(df, r"[_\s]+").select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"))


def queries(df: DataFrame) -> DataFrame:
    """`s1 s2;t1 t2` to (sources, targets), each sorted and distinct."""
    f = F.split("value", ";")
    return df.where(F.trim("value") != "").select(parse_ids(f[0]).alias("sources"), parse_ids(f[1]).alias("targets"))


def numbered(df: DataFrame, order: str, skip: int = 0, take: int | None = None) -> DataFrame:
    """Rows ``skip`` to ``skip + take`` in the order of a unique column, with query_id from 0. Other columns may have any names."""
    out = ranked(df, order, "query_id").where(F.col("query_id") >= skip)
    return out if take is None else out.where(F.col("query_id") < skip + take)


def results(df: DataFrame, *keys: str) -> DataFrame:
    """`S;T; c1 c2 ...; ...` to (keys, sources, targets, colors): the input of an evaluation."""
    f = F.split("value", ";")
    return df.where(F.trim("value") != "").select(*keys, parse_ids(f[0]).alias("sources"), parse_ids(f[1]).alias("targets"), parse_ids(f[2]).alias("colors"))


def targets(df: DataFrame) -> DataFrame:
    """Blank-separated ids to distinct (node)."""
    return df.select(F.explode(parse_ids(F.col("value"))).alias("node")).distinct()


def dictionary(df: DataFrame) -> DataFrame:
    """`name id` to (name, id)."""
    f = F.col("f")
    return _fields(df).select(f[0].alias("name"), f[1].cast("long").alias("id"))


def publications(spark: SparkSession, path: str) -> DataFrame:
    """Bibliography XML to (author, booktitle) with one row for each inproceedings element."""
    return spark.read.format("xml").option("rowTag", "inproceedings").schema("author array<string>, booktitle string").load(path)
