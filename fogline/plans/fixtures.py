"""Graphs, queries and text lines that the driver's tables give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fogline.functions.runtime import materialize, read


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation to supplier nation, colored by order priority; all pairs. (src, dst, color, p_pct)"""
    return materialize(_trade_edges(_sold(spark, sf_dir)), "trade")


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_discount") * 100).cast("long").alias("d"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("color"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))


def _trade_edges(sold: DataFrame) -> DataFrame:
    return sold.where(F.col("src") != F.col("dst")).groupBy("src", "dst", "color").agg((5 + F.sum("d") % 30).cast("long").alias("p_pct"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User to the user of the next event of the same kind and day. (src, dst, color, p_pct, edge_id); it grows with events.

    Events of a kind meet by the hour only. The last of an hour is followed by the first of the next hour of that day with events; a
    kind and day have 24 such rows at most.
    """
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
    hours = ["event_type", "day", "hour"]
    firsts = events.groupBy(*hours).agg(F.min(F.struct("ts", "event_id", "user_id"))["user_id"].alias("first"))
    later = firsts.select(*hours, F.lead("first").over(W.partitionBy("event_type", "day").orderBy("hour")).alias("later"))
    within = events.withColumn("next", F.lead("user_id").over(W.partitionBy(*hours).orderBy("ts", "event_id")))
    color = F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col("event_type")).cast("long")
    edges = within.join(later, hours).withColumn("dst", F.coalesce("next", "later")).where("dst is not null and dst != user_id")
    return materialize(edges.select(F.col("user_id").alias("src"), "dst", color.alias("color"), (1 + F.col("event_id") % 10).cast("long").alias("p_pct"), F.col("event_id").alias("edge_id")), "flow")


def region_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, sources, targets): from the first two nations of each region to the first three of the next."""
    nations = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("r")).agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("long"))).alias("keys"))
    to = nations.select(((F.col("r") + 4) % 5).alias("r"), F.slice("keys", 1, 3).alias("targets"))
    return materialize(nations.join(to, "r").select(F.col("r").alias("query_id"), F.slice("keys", 1, 2).alias("sources"), "targets"), "queries")


def region_colors(queries: DataFrame) -> DataFrame:
    """(query_id, color): two colors for each query."""
    return queries.select("query_id", F.explode(F.array(F.col("query_id") % 5 + 1, (F.col("query_id") + 2) % 5 + 1)).alias("color"))


def flow_ends(edges: DataFrame) -> DataFrame:
    """(query_id, node): the nodes divisible by 50."""
    ids = edges.select(F.col("src").alias("node")).where("node % 50 = 0").distinct()
    return ids.select(F.col("node").alias("query_id"), "node")


#: The same in SQL, as common table expressions.
TRADE_SQL = """
g as (
  select cast(c_nationkey as bigint) as src, cast(s_nationkey as bigint) as dst, cast(substr(o_orderpriority, 1, 1) as bigint) as color,
         cast(5 + mod(sum(cast(round(l_discount * 100) as bigint)), 30) as bigint) as p_pct
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where c_nationkey <> s_nationkey group by 1, 2, 3)"""
FLOW_SQL = """
f0 as (
  select event_id, user_id, event_type, lead(user_id) over (partition by event_type, cast(ts as date) order by ts, event_id) as dst from events),
g as (
  select user_id as src, dst, cast(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) as bigint) as color,
         cast(1 + event_id % 10 as bigint) as p_pct, event_id as edge_id
  from f0 where dst is not null and dst <> user_id)"""
QUERIES_SQL = """
n0 as (select cast(n_regionkey as bigint) as r, list(cast(n_nationkey as bigint) order by n_nationkey) as keys from nation group by 1),
q as (select a.r as query_id, a.keys[1:2] as sources, b.keys[1:3] as targets from n0 a join n0 b on (b.r + 4) % 5 = a.r)"""
