"""Driver queries: one for each operator of the survey, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fogline.functions import names
from fogline.functions.runtime import materialize, read, scratch_path, small
from fogline.operators import etl, graph, hubs, influence, objectives, paths, select, steiner
from fogline.operators.reach import edge_masks, reach, start, worlds_of_all
from fogline.operators.wide import wide_masks
from fogline.plans import lines
from fogline.plans import oracle as sql
from fogline.plans.fixtures import QUERIES_SQL, TRADE_SQL, flow, flow_ends, region_colors, region_queries, trade
from fogline.sources import graph_text, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Samples as the reference draws them: of a color by itself and of a cascade, of a color added to others, of an evaluation.
WORLDS, ADDED, EVALUATED = 1000, 100, 50


def query(text: str | None = None, name: str = "") -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if text:
            SQL[name or f.__name__] = text
        return f

    return add


def joined(ids: str):
    """An array of ids as text."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias(ids)


G, GQ = f"with {TRADE_SQL.strip()}\n", f"with {TRADE_SQL.strip()},\n{QUERIES_SQL.strip()}\n"
GF = f"with {sql.FLOW_SQL.strip()}\n"
IDS = "array_to_string({0}, ' ') as {0}"


# scans and sinks -------------------------------------------------------------------------------------------------------


@query(G + "select src, dst, cast(p_pct as double) as p, color from g")
def src_1(spark, sf_dir):
    """Wide graph lines, written from the trade graph and parsed."""
    return graph_text.wide_graph(sinks.wide_lines(trade(spark, sf_dir).withColumn("p", F.col("p_pct"))))


@query(G + "select src, dst, p_pct from g where color = 1 union all select dst, src, p_pct from g where color = 1")
def src_2(spark, sf_dir):
    """Collapsed graph lines `u v p` to whole percent, in both directions."""
    one = trade(spark, sf_dir).where("color = 1").withColumn("p", F.concat(F.lit("0."), F.lpad(F.col("p_pct").cast("string"), 2, "0")))
    return graph.bidirected(graph_text.collapsed_graph(sinks.collapsed_lines(one)).drop("p"))


@query(f"with {QUERIES_SQL.strip()} select query_id, {IDS.format('sources')}, {IDS.format('targets')} from q where query_id >= 1 and query_id < 4")
def src_3(spark, sf_dir):
    """Query lines 1 to 3."""
    q = region_queries(spark, sf_dir)
    lines = q.select("query_id", F.concat(joined("sources"), F.lit(";"), joined("targets")).alias("value"))
    parsed = graph_text.numbered(graph_text.queries(lines), "sources", skip=1, take=3)
    return parsed.select("query_id", joined("sources"), joined("targets"))


@query("select o_orderkey, case when o_custkey = o_orderkey % 100 then o_custkey::varchar else least(o_custkey, o_orderkey % 100) || ' ' || greatest(o_custkey, o_orderkey % 100) end as nodes from orders")
def src_4(spark, sf_dir):
    """Node sets, sorted and distinct."""
    line = F.concat_ws(" ", "o_custkey", F.col("o_orderkey") % 100, "o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", names.parse_ids(line).alias("nodes")).select("o_orderkey", joined("nodes"))


@query("select o_custkey as node from orders union select o_custkey % 7 from orders")
def src_5(spark, sf_dir):
    """Distinct targets of many lines."""
    return graph_text.targets(read(spark, sf_dir, "orders").select(F.concat_ws(" ", "o_custkey", F.col("o_custkey") % 7).alias("value")))


@query("select author, count(*) as n from (select unnest([source, 'author' || (doc_id % 37)]) as author from documents) group by 1")
def src_6(spark, sf_dir):
    """Publications written as XML and read by the XML source: one row for each inproceedings element."""
    path = scratch_path(spark, "publications")
    _papers(spark, sf_dir).write.format("xml").option("rootTag", "dblp").option("rowTag", "inproceedings").save(path)
    return graph_text.publications(spark, path).select(F.explode("author").alias("author")).groupBy("author").agg(F.count("*").alias("n"))


@query("select n_name as name, cast(n_nationkey as bigint) as id from nation")
def src_7(spark, sf_dir):
    """Dictionary lines `name id`."""
    return graph_text.dictionary(read(spark, sf_dir, "nation").select(F.concat_ws(" ", "n_name", "n_nationkey").alias("value")))


@query("select l_partkey as src, l_suppkey as dst from lineitem")
def src_8(spark, sf_dir):
    """Endpoints `u_v`."""
    return graph_text.joined_endpoints(read(spark, sf_dir, "lineitem").select(F.concat(F.concat_ws("_", "l_partkey", "l_suppkey"), F.lit(" 1")).alias("value")))


@query(GQ + "select array_to_string(sources, ' ') || ';' || array_to_string(targets, ' ') || '; ' || (query_id % 5 + 1) || ' ' || ((query_id + 2) % 5 + 1) || '; 2; Loop: 32; Time: 0' as value from q")
def snk_1(spark, sf_dir):
    """Result lines."""
    q = region_queries(spark, sf_dir).withColumn("colors", F.array(F.col("query_id") % 5 + 1, (F.col("query_id") + 2) % 5 + 1))
    return sinks.result_lines(q.withColumns({"found": F.lit(2), "loops": F.lit(32), "seconds": F.lit(0)}))


@query("select c_nationkey || ';' || c_custkey || '; Eval: ' || count(o_orderkey) || ' 50; Evaltime: 0' as value from customer left join orders on o_custkey = c_custkey group by c_nationkey, c_custkey")
def snk_2(spark, sf_dir):
    """Evaluation lines, of the orders of each customer."""
    customers = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    counts = customers.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_nationkey", "c_custkey").agg(F.count("o_orderkey").alias("metric"))
    return sinks.eval_lines(counts.select(F.concat_ws(";", "c_nationkey", "c_custkey").alias("line"), "metric", F.lit(EVALUATED).alias("worlds"), F.lit(0).alias("seconds")))


@query(GF + ", d as (select src as node, count(*) as n from g group by 1) select row_number() over (order by n desc, node) || ' ' || node || ' ' || cast(n / 8 as double) as value from d order by n desc, node limit 50")
def snk_3(spark, sf_dir):
    """Lines of the 50 seeds of largest out-degree; eighths are exact as doubles."""
    degrees = flow(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("hits")).orderBy(F.col("hits").desc(), "node").limit(50)
    return sinks.seed_lines(degrees.select(F.row_number().over(W.orderBy(F.col("hits").desc(), "node")).alias("rank"), "node", "hits", F.lit(8).alias("worlds")))


@query(G + "select run, color, count(*) as edges, cast(sum(p_pct) as bigint) as p_pct from g, (values (1), (2)) r(run) group by run, color")
def snk_5(spark, sf_dir):
    """Statistics of two runs, appended to one table."""
    path = scratch_path(spark, "statistics")
    found = trade(spark, sf_dir).groupBy("color").agg(F.count("*").alias("edges"), F.sum("p_pct").alias("p_pct"))
    for run in (1, 2):
        sinks.append_statistics(found.select(F.lit(run).alias("run"), "color", "edges", "p_pct"), path)
    return spark.read.parquet(path)


@query(G + "select src || ' ' || dst || ' ' || p_pct || ' ' || color as value from g")
def snk_4(spark, sf_dir):
    """Long graph lines."""
    return sinks.long_lines(trade(spark, sf_dir).withColumn("p", F.col("p_pct")))


@query(G + "select src, '{' || array_to_string(list_sort(list(distinct color)), ', ') || '}' as colors from g group by src")
def snk_6(spark, sf_dir):
    """Printed color sets of the nodes."""
    return trade(spark, sf_dir).groupBy("src").agg(names.format_set(F.collect_set("color")).alias("colors"))


PRINTED = [*sql.BASE, sql.ARCS, *sql.walks(5), "x as (select query_id, rank, unnest(string_split(path, '|')) as edge, generate_subscripts(string_split(path, '|'), 1) as position from walk)", "p as (select query_id, rank, min_by(src, position) || string_agg('-(c:' || color || ',cost:' || a.cost || ')->' || dst, '' order by position) || ' path-cost: ' || sum(a.cost) as value from x join arcs a using (edge) group by 1, 2)"]


@query(sql.recursive(*PRINTED, "select query_id, string_agg('{' || value || '}', ' ' order by rank) as value from p group by 1"))
def snk_6_paths(spark, sf_dir):
    """Printed walks of each query."""
    edges = graph.identified(trade(spark, sf_dir))
    walks = paths.walk_edges(edges, region_queries(spark, sf_dir), 5)
    return sinks.path_set_lines(graph.path_edges(walks.withColumn("path_id", F.col("rank")), edges))


@query(GF + f"select src || '-(c:' || color || ',cost:' || {sql.COST} || ')->' || dst as value from g")
def snk_6_graph(spark, sf_dir):
    """The printed edges of the event graph."""
    return sinks.graph_lines(flow(spark, sf_dir))


# graph shaping ---------------------------------------------------------------------------------------------------------


@query(GQ + "select query_id, cast(-1 as bigint) as src, unnest(sources) as dst, cast(-1 as bigint) as color, cast(100 as bigint) as p_pct from q union all select query_id, unnest(targets), -2, -1, 100 from q union all select null, src, dst, color, p_pct from g")
def gx_1(spark, sf_dir):
    """The graph with super sources and sinks."""
    return graph.extended(trade(spark, sf_dir), region_queries(spark, sf_dir))


@query(G + "select * from g union all select dst, src, color, p_pct from g")
def gx_3(spark, sf_dir):
    """Both directions."""
    return graph.bidirected(trade(spark, sf_dir))


@query(G + f"select src, dst, color, p_pct, {sql.COST} as cost from g")
def gx_4(spark, sf_dir):
    """Costs."""
    return graph.with_cost(trade(spark, sf_dir))


@query(GF + "select src, dst, color, p_pct, edge_id from g where color in (1, 3)")
def gx_5(spark, sf_dir):
    """Edges of two colors."""
    edges = flow(spark, sf_dir)
    return graph.of_colors(edges, edges.where("color in (1, 3)").select("color").distinct())


@query(GQ + "select query_id, count(*) as edges from q, g where color in (query_id % 5 + 1, (query_id + 2) % 5 + 1) group by query_id")
def gx_6(spark, sf_dir):
    """Edges that each query's own colors leave, without neutral ones."""
    chosen = region_colors(region_queries(spark, sf_dir))
    return trade(spark, sf_dir).join(small(chosen), "color").groupBy("query_id").agg(F.count("*").alias("edges"))


@query(GF + ", n as (select src as v from g union select dst from g), c as (select distinct user_id as v from events union select o_custkey from orders) select count(*) as bad from c where v not in (select v from n)")
def gx_7(spark, sf_dir):
    """How many single-node queries name a node without edges."""
    ids = read(spark, sf_dir, "events").select(F.col("user_id").alias("v")).union(read(spark, sf_dir, "orders").select("o_custkey")).distinct()
    asked = ids.select(F.col("v").alias("query_id"), F.array("v").alias("sources"), F.array("v").alias("targets"))
    return graph.unknown_queries(asked, flow(spark, sf_dir)).agg(F.count("*").alias("bad"))


@query(GF + "select count(distinct color) as colors from g having count(distinct color) >= 5")
def gx_8(spark, sf_dir):
    """The colors of a graph that has enough of them; it raises where there are fewer than 5."""
    edges = flow(spark, sf_dir)
    graph.require_colors(edges, 5)
    return graph.colors(edges).agg(F.count("*").alias("colors"))


@query(GF + "select src, dst, min(color) as color, min(p_pct) as p_pct from (select *, rank() over (partition by src, dst order by color, p_pct) as r from g) where r = 1 and src < dst group by src, dst")
def gx_9(spark, sf_dir):
    """The first edge between two nodes."""
    edges = flow(spark, sf_dir)
    return graph.first_edge(edges, edges.where("src < dst").select("src", "dst").distinct())


@query(sql.recursive(*sql.BASE, sql.ARCS, *sql.walks(5), "e as (select query_id, cast(rank as bigint) as path_id, unnest(string_split(path, '|')) as label, generate_subscripts(string_split(path, '|'), 1) - 1 as position from walk)", f"select query_id, path_id, cast(position as int) as position, g.src, g.dst, g.color, g.p_pct from e join (select *, {sql.EDGE} as edge from g) g on g.edge = label"))
def gx_10(spark, sf_dir):
    """The edges of paths."""
    edges = graph.identified(trade(spark, sf_dir))
    walks = paths.walk_edges(edges, region_queries(spark, sf_dir), 5)
    walked = graph.path_edges(walks.withColumn("path_id", F.col("rank").cast("long")), edges)
    return walked.select("query_id", "path_id", "position", "src", "dst", "color", F.round(F.col("p") * 100).cast("long").alias("p_pct"))


@query(sql.recursive(*sql.BASE, sql.ARCS, *sql.walks(5), "e as (select query_id, cast(rank as bigint) as path_id, string_split(path, '|') as labels from walk)", "select query_id, path_id, cast(string_split(labels[1], '>')[1] as bigint) as first, cast(string_split(string_split(labels[len(labels)], '>')[2], '#')[1] as bigint) as last from e"))
def gx_13(spark, sf_dir):
    """First and last node of each walk."""
    return graph.path_ends(gx_10(spark, sf_dir))


@query(GF + "select src, dst, color, max(p_pct) as p_pct from g group by 1, 2, 3")
def gx_11(spark, sf_dir):
    """One edge a color between two nodes."""
    return graph.deduplicated(flow(spark, sf_dir))


@query(sql.recursive(*sql.BASE, sql.ARCS, *sql.walks(5), "e as (select query_id, cast(rank as bigint) as path_id, unnest(string_split(path, '|')) as label from walk)", "select query_id, path_id, array_to_string(list_sort(list(distinct cast(string_split(label, '#')[2] as bigint))), ' ') as colors from e group by 1, 2"))
def gx_12(spark, sf_dir):
    """The colors of paths."""
    return graph.path_colors(gx_10(spark, sf_dir)).select("query_id", "path_id", joined("colors"))


# relational helpers ----------------------------------------------------------------------------------------------------


@query(GF + "select src, dst, color, p_pct from g")
def rel_1(spark, sf_dir):
    """Wide rows exploded to one row a pair."""
    wide = flow(spark, sf_dir).groupBy("src", "dst").agg(F.collect_list(F.struct("color", "p_pct")).alias("pairs"))
    return wide.select("src", "dst", F.inline("pairs"))


@query(G + "select src, dst, count(*) as n, product(100 - p_pct order by p_pct desc) as miss from g group by 1, 2")
def rel_2(spark, sf_dir):
    """Noisy-or, as the exact chance that no edge exists."""
    return influence.noisy_or(trade(spark, sf_dir))


@query(G + "select src, dst, cast(floor(round((1.0::double - product(case when color in (1, 2) then (100 - p_pct) / 100.0::double else 1.0::double end order by case when color in (1, 2) then 100 - p_pct else 100 end)) * 100.0::double, 6)) as bigint) as p_pct from g group by 1, 2")
def rel_2_colors(spark, sf_dir):
    """The graph collapsed under two colors."""
    edges = trade(spark, sf_dir)
    return influence.collapse(edges, edges.where("color in (1, 2)").select("color").distinct())


@query(GF + "select max(greatest(src, dst)) as max_id from g")
def rel_3(spark, sf_dir):
    """The largest id."""
    return etl.largest_id(flow(spark, sf_dir))


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.array("source", F.concat(F.lit("author"), F.col("doc_id") % 37)).alias("author"), F.concat(F.lit("Proc. "), F.upper("lang")).alias("booktitle"))


@query("select author, count(*) as count from (select unnest([source, 'author' || (doc_id % 37)]) as author from documents where lang in ('en', 'fr')) group by 1 having count(*) >= 20")
def rel_4(spark, sf_dir):
    """Authors with enough papers at some venues."""
    return etl.frequent_authors(_papers(spark, sf_dir), ["en", "Fr"], 20)


@query("select author, count(*) as count from (select unnest([source, 'author' || (doc_id % 37)]) as author from documents) group by 1 having count(*) >= 20 order by 2 desc, 1 limit 7")
def rel_4_number(spark, sf_dir):
    """The seven most frequent authors."""
    return etl.frequent_authors(_papers(spark, sf_dir), ["Proc"], 20, 7)


@query("select lang, count(*) as n from documents where lower(text) like '%license%' group by 1")
def rel_5(spark, sf_dir):
    """Texts with a word in any case."""
    return read(spark, sf_dir, "documents").where(names.contains_any(F.col("text"), ["License"])).groupBy("lang").agg(F.count("*").alias("n"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src_7(spark, sf_dir)


@query("select c_custkey, lower(n_name) as name, cast(n_nationkey as bigint) as id from customer join nation on c_nationkey = n_nationkey")
def lk_1(spark, sf_dir):
    """Names to ids, in any case."""
    asked = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("nation_"), "c_nationkey").alias("name"))
    known = etl.ids_of(asked.select("name").distinct(), _nations(spark, sf_dir))
    return asked.join(small(known), "name")


@query("select c_custkey, n_name as name from customer join nation on c_nationkey = n_nationkey")
def lk_2(spark, sf_dir):
    """Ids to names."""
    asked = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("id"))
    return asked.join(small(etl.names_of(asked.select("id").distinct(), _nations(spark, sf_dir))), "id").select("c_custkey", "name")


KINDS_SQL = "k as (select event_type as name, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) as id from events group by 1)"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().withColumn("id", F.array_position(kinds, F.col("name")).cast("long"))


@query(f"with {KINDS_SQL} select event_id, cast(id as bigint) as color from events join k on name = event_type")
def lk_3(spark, sf_dir):
    """Color names to ids."""
    asked = read(spark, sf_dir, "events").select("event_id", F.upper("event_type").alias("name"))
    return asked.join(small(etl.ids_of(asked.select("name").distinct(), _kinds(spark, sf_dir))), "name").select("event_id", F.col("id").alias("color"))


@query(GF.strip() + f", {KINDS_SQL} select edge_id, name from g join k on id = color")
def lk_4(spark, sf_dir):
    """Color ids to names."""
    asked = flow(spark, sf_dir).select("edge_id", F.col("color").alias("id"))
    return asked.join(small(etl.names_of(asked.select("id").distinct(), _kinds(spark, sf_dir))), "id").select("edge_id", "name")


@query("select doc_id, lower(replace(trim(text, ' '), ' ', '_')) as name from documents")
def str_1(spark, sf_dir):
    """Normalised names."""
    return read(spark, sf_dir, "documents").select("doc_id", names.normalised(F.col("text")).alias("name"))


@query("select distinct source as name from documents")
def str_2(spark, sf_dir):
    """The keys of a dictionary."""
    return read(spark, sf_dir, "documents").select(F.explode(F.map_keys(F.create_map("source", "doc_id"))).alias("name")).distinct()


@query("select row_number() over (order by n desc, source) || '. ' || source as label from (select source, count(*) as n from documents group by 1)")
def str_3(spark, sf_dir):
    """Ranked labels, with a row for each source."""
    counted = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.orderBy(F.col("n").desc(), "source"))
    return counted.select(names.ranked_label(rank, F.col("source")).alias("label"))


@query("select user_id, count(*) as n from events group by 1 order by 2 desc, 1 limit 25")
def sort_1(spark, sf_dir):
    """The most active users."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(25)


@query("select distinct 'nation_' || (o_custkey % 40) as name from orders where o_custkey % 40 >= 25")
def set_1(spark, sf_dir):
    """Names that the dictionary lacks."""
    asked = read(spark, sf_dir, "orders").select(F.concat(F.lit("nation_"), F.col("o_custkey") % 40).alias("name")).distinct()
    return etl.missing(asked, _nations(spark, sf_dir))


@query("select r_name, string_agg(n_nationkey::varchar, ' ' order by n_nationkey) as line from nation join region on n_regionkey = r_regionkey where n_name <> 'NATION_7' group by 1")
def awk_1(spark, sf_dir):
    """One query line a region."""
    kept = read(spark, sf_dir, "nation").where("n_name != 'NATION_7'").join(small(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return kept.groupBy("r_name").agg(F.array_sort(F.collect_list("n_nationkey")).alias("line")).select("r_name", joined("line"))


@query("select user_id, arg_max(value, (ts, event_id)) as last_value from events group by 1")
def awk_2(spark, sf_dir):
    """The last value of each user."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query(GQ + "select query_id, s as source, t as target from (select query_id, unnest(sources) as s, targets from q) a, lateral (select unnest(targets)) b(t) where s <> t")
def j_5(spark, sf_dir):
    """All pairs of a query with different ends."""
    return objectives.pairs(region_queries(spark, sf_dir))


@query("with c as (select user_id as v, cast(1 << (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1) as bigint) as m, count(*) as n from events group by 1, 2) select a.v, a.m | b.m as m, min(a.n + b.n) as n from c a join c b on a.v = b.v and a.m & b.m = 0 group by 1, 2")
def j_8(spark, sf_dir):
    """Cells of a node with disjoint masks, merged."""
    kinds = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(kinds, F.col("event_type")) - 1).cast("int"))
    cells = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("v"), bit.alias("m")).agg(F.count("*").alias("n"))
    other = cells.select("v", F.col("m").alias("m2"), F.col("n").alias("n2"))
    both = cells.join(other, "v").where(F.col("m").bitwiseAND(F.col("m2")) == 0)
    return both.groupBy("v", F.col("m").bitwiseOR(F.col("m2")).alias("m")).agg(F.min(F.col("n") + F.col("n2")).alias("n"))


@query(sql.recursive(*sql.BASE, sql.ARCS, *sql.walks(20), "e as (select query_id, rank, unnest(string_split(path, '|')) as label from walk)", "p as (select query_id, rank, bool_and(cast(string_split(label, '#')[2] as bigint) in (1, 2, 3)) as inside from e group by 1, 2)", "select query_id, bool_or(inside) as covered, count(*) filter (where inside) as paths from p group by 1"))
def j_9(spark, sf_dir):
    """Queries with a path of three colors only."""
    edges = graph.identified(trade(spark, sf_dir))
    walks = paths.walk_edges(edges, region_queries(spark, sf_dir), 20).withColumn("path_id", F.col("rank").cast("long"))
    told = graph.path_colors(graph.path_edges(walks, edges))
    inside = F.size(F.array_except("colors", F.array(*[F.lit(c).cast("long") for c in (1, 2, 3)]))) == 0
    return told.withColumn("inside", inside).groupBy("query_id").agg(F.bool_or("inside").alias("covered"), F.sum(F.col("inside").cast("long")).alias("paths"))


# sampling --------------------------------------------------------------------------------------------------------------


def _flow_reach(spark: SparkSession, sf_dir: str) -> hubs.Shared:
    edges = flow(spark, sf_dir)
    return hubs.shared_reach(wide_masks(edges, WORLDS), flow_ends(edges), ["query_id"], WORLDS, arcs=edges.count())


@query(sql.recursive(*sql.flow_reach(WORLDS), "select query_id, v as node, count(*) as hits from reach where v <> query_id group by 1, 2"))
def mc_1(spark, sf_dir):
    """Worlds in which each node is reached from some sources, on the event graph."""
    return hubs.pair_hits(_flow_reach(spark, sf_dir), ["query_id"], WORLDS).where("node != query_id")


@query(sql.recursive(*sql.flow_reach(WORLDS), "select query_id, count(*) as hits from reach where v <> query_id group by 1"))
def mc_2(spark, sf_dir):
    """Nodes reached from each source, summed over the worlds, on the event graph."""
    every = hubs.spread_of_starts(_flow_reach(spark, sf_dir), ["query_id"])
    return every.select("query_id", (F.col("hits") - WORLDS).alias("hits")).where("hits > 0")  # each source reaches itself in all worlds


@query(sql.recursive(*sql.BASE, sql.COLORS, sql.live(WORLDS), *sql._first("q"), *sql.score("max"), "select query_id, cand as color, s as source, t as target, hits from ph"))
def mc_3(spark, sf_dir):
    """Reach of each pair under each color by itself."""
    edges, q = trade(spark, sf_dir), region_queries(spark, sf_dir)
    cands = q.select("query_id").crossJoin(graph.colors(edges).select(F.col("color").alias("cand")))
    keys = ["query_id", "cand", "source"]
    seeds = q.join(cands, "query_id").select("query_id", "cand", F.explode("sources").alias("source")).withColumn("node", F.col("source"))
    reached = reach(edge_masks(edges, WORLDS), start(seeds, WORLDS), keys, cands.withColumn("color", F.col("cand")), ["query_id", "cand"])
    return objectives.pair_scores(reached, q, cands).withColumnRenamed("cand", "color")


def _conn(spark: SparkSession, sf_dir: str, directed: bool = True) -> DataFrame:
    edges, q = trade(spark, sf_dir), region_queries(spark, sf_dir)
    ends = q.select("query_id", F.explode(F.array_union("sources", "targets")).alias("node"))
    reached = reach(edge_masks(edges, WORLDS, directed), start(ends.withColumn("root", F.col("node")), WORLDS), ["query_id", "root"])
    return worlds_of_all(reached, ends, ["query_id", "root"])


CONN_SQL = [*sql.BASE, sql.COLORS, LIVE := sql.live(WORLDS), "cand as (select query_id, 0 as cand from q)", "allow as (select query_id, 0 as cand, color from q, colors)", *sql.score("conn")]


@query(sql.recursive(*CONN_SQL, "select a.query_id, s as root, count(*) as hits from ev a join (select query_id, len(list_distinct(list_concat(sources, targets))) as k from q) z on z.query_id = a.query_id where got = k group by 1, 2"))
def mc_4(spark, sf_dir):
    """Worlds in which a root reaches all terminals."""
    return _conn(spark, sf_dir)


@query(sql.recursive(*CONN_SQL, "select query_id, hits from score where hits > 0"))
def mc_5(spark, sf_dir):
    """The best root."""
    return _conn(spark, sf_dir).groupBy("query_id").agg(F.max("hits").alias("hits"))


@query(sql.recursive(*[sql.live_undirected(WORLDS) if x is LIVE else x for x in CONN_SQL], "select query_id, s as root, hits from (select a.query_id, s, count(*) as hits from ev a join (select query_id, len(list_distinct(list_concat(sources, targets))) as k from q) z on z.query_id = a.query_id where got = k group by 1, 2)"))
def mc_5_undirected(spark, sf_dir):
    """The same where edges lead both ways: each root reaches all terminals in the same worlds."""
    return _conn(spark, sf_dir, directed=False)


@query(sql.evaluate("s", 50, p="(p_pct // 10) / 10.0::double"))
def mc_6(spark, sf_dir):
    """Evaluation of a pair with probabilities rounded down to tenths."""
    q = region_queries(spark, sf_dir)
    return objectives.evaluate(trade(spark, sf_dir), q, region_colors(q), "s", 50, quantise=10)


@query(sql.recursive(*sql.flow_reach(WORLDS, reverse=True), "select count(*) as hits from (select distinct query_id, w from reach where v % 50 <> 0)"))
def mc_7(spark, sf_dir):
    """Targets, the nodes divisible by 50, that a cascade from all other nodes reaches, over all worlds."""
    edges = flow(spark, sf_dir)
    others = edges.select(F.col("src").alias("node")).where("node % 50 != 0").distinct()
    hit = influence.cascade_hits(edges, others, flow_ends(edges).select("node"), WORLDS)
    return hit.agg(F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("hits"))


MC8 = [*sql.walks(20), "pe as (select distinct query_id, label from (select query_id, unnest(string_split(path, '|')) as label from walk))", f"lv as (select w, query_id, l.src, l.dst from pe join (select *, {sql.EDGE} as edge from live) l on l.edge = label where l.color in (1, 2, 3))", "r8 as (select query_id, w, unnest(sources) as v from q, ws union select r.query_id, r.w, l.dst from r8 r join lv l on l.query_id = r.query_id and l.w = r.w and l.src = r.v)"]


@query(sql.recursive(*sql.BASE, sql.ARCS, sql.live(WORLDS), *MC8, "select q.query_id, count(distinct w) as hits from q join r8 on r8.query_id = q.query_id and list_contains(targets, v) group by 1"))
def mc_8(spark, sf_dir):
    """Reach within the walks of a query under three colors."""
    edges, q = graph.identified(trade(spark, sf_dir)), region_queries(spark, sf_dir)
    walks = paths.walk_edges(edges, q, 20).withColumn("path_id", F.col("rank").cast("long"))
    own = graph.path_edges(walks, edges).where("color in (1, 2, 3)").select("query_id", F.lit(0).cast("long").alias("cand"), *graph.EDGE).distinct()
    scores = select._scored(own, q, q.select("query_id", F.lit(0).cast("long").alias("cand")), "sum", WORLDS)
    return scores.where("hits > 0").select("query_id", "hits")


# paths and trees -------------------------------------------------------------------------------------------------------


@query(sql.recursive(*sql.BASE, sql.ARCS, sql.ONE, *sql.walks(10, "q1"), "select * from walk"))
def sp_1(spark, sf_dir):
    """The ten most reliable walks between two nodes."""
    return paths.top_walks(trade(spark, sf_dir), objectives._single(region_queries(spark, sf_dir)), 10).select("query_id", "rank", "cost", "path")


@query(sql.recursive(*sql.BASE, sql.ARCS, *sql.walks(10), "select * from walk"))
def sp_2(spark, sf_dir):
    """The ten most reliable walks between two sets."""
    return paths.top_walks(trade(spark, sf_dir), region_queries(spark, sf_dir), 10).select("query_id", "rank", "cost", "path")


@query(sql.recursive(*sql.BASE, sql.ARCS, *sql.walks(25, backtrack=True), "select * from walk"))
def sp_3(spark, sf_dir):
    """Walks that may step back."""
    return paths.top_walks(trade(spark, sf_dir), region_queries(spark, sf_dir), 25, backtrack=True).select("query_id", "rank", "cost", "path")


def _dist(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = graph.identified(trade(spark, sf_dir))
    ends = region_queries(spark, sf_dir).select(F.array_min("targets").alias("target")).distinct()
    return edges, paths.distances(edges, ends)


DIST = [*sql.BASE, sql.ARCS, sql.DIST, sql.ENDS, sql.PARENT]


@query(sql.recursive(*DIST, "select target, node, dist, parent from parent"))
def sp_4(spark, sf_dir):
    """Shortest-path trees to targets."""
    edges, dist = _dist(spark, sf_dir)
    return dist.join(graph.printed(edges), F.col("parent") == F.col("edge_id"), "left").select("target", "node", "dist", F.col("label").alias("parent"))


@query(sql.recursive(*DIST, sql.PENALTY, "select target, src, dst, color, penalty from pen"))
def sp_5(spark, sf_dir):
    """Side-track penalties."""
    return paths.penalties(*_dist(spark, sf_dir)).drop("edge_id")


@query(sql.recursive(*DIST, sql.PENALTY, "select p.target, src, dst, color, penalty, cast(row_number() over (partition by p.target, src order by penalty, edge) as int) as rank from pen p join parent t on t.target = p.target and t.node = p.src where t.parent is null or edge <> t.parent qualify rank <= 3"))
def sp_6(spark, sf_dir):
    """The best side-tracks of each node."""
    return paths.side_tracks(*_dist(spark, sf_dir), 3).drop("edge_id")


def _terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_queries(spark, sf_dir).select("query_id", F.explode(F.array_union("sources", "targets")).alias("node"))


def _trees(spark: SparkSession, sf_dir: str, directed: bool) -> DataFrame:
    ends = _terminals(spark, sf_dir)
    whole = ends.groupBy("query_id").agg((F.call_function("shiftleft", F.lit(1).cast("long"), F.count("*").cast("int")) - 1).alias("mask"))
    return steiner.tree_states(trade(spark, sf_dir), ends, directed).join(whole, ["query_id", "mask"]).select("query_id", "node", "cost")


@query(sql.steiner())
def st_1(spark, sf_dir):
    """The least cost of a tree over all terminals of a query to each root."""
    return _trees(spark, sf_dir, True)


@query(sql.steiner(directed=False))
def st_1_undirected(spark, sf_dir):
    """The same where edges lead both ways."""
    return _trees(spark, sf_dir, False)


@query()
def st_2(spark, sf_dir):
    """The ten cheapest different trees over all terminals of a query."""
    edges = graph.identified(trade(spark, sf_dir))
    trees = materialize(steiner.top_trees(edges, _terminals(spark, sf_dir), 10), "trees")
    return graph.with_paths(trees, edges, ["query_id", "rank"]).select("query_id", "rank", "root", "cost", F.col("path").alias("tree"))


# selection and objectives ----------------------------------------------------------------------------------------------

K = 2


def _register(objective: str) -> None:
    def run_eval(spark, sf_dir):
        q = region_queries(spark, sf_dir)
        return objectives.evaluate(trade(spark, sf_dir), q, region_colors(q), objective, EVALUATED)

    def run_b1(spark, sf_dir):
        return objectives.baseline1(trade(spark, sf_dir), region_queries(spark, sf_dir), K, objective, WORLDS)

    def run_b2(spark, sf_dir):
        return objectives.baseline2(trade(spark, sf_dir), region_queries(spark, sf_dir), K, objective, ADDED)

    def run_h(spark, sf_dir):
        return select.heuristic(trade(spark, sf_dir), region_queries(spark, sf_dir), 3, 10, objective, WORLDS)

    query(sql.evaluate(objective, EVALUATED), f"obj_{objective}_eval")(run_eval)
    query(sql.baseline1(objective, K, WORLDS), f"obj_{objective}_b1")(run_b1)
    query(sql.baseline2(objective, ADDED), f"obj_{objective}_b2")(run_b2)
    query(None if objective == "conn" else sql.heuristic(objective, 3, 10, WORLDS), f"obj_{objective}_h")(run_h)


for _objective in objectives.OBJECTIVES:
    _register(_objective)

TOP = "select query_id, cast(rank as int) as rank, cand as color, hits from (select *, row_number() over (partition by query_id order by hits desc, cand) as rank from s where hits > 0) where rank <= 3"


@query(GF + ", s as (select src as query_id, color as cand, count(*) as hits from g group by 1, 2) " + TOP)
def topk_1(spark, sf_dir):
    """The three most frequent colors out of each node."""
    return objectives.top_k(flow(spark, sf_dir).groupBy(F.col("src").alias("query_id"), F.col("color").alias("cand")).agg(F.count("*").alias("hits")), 3)


@query(GF + ", c as (select src as query_id, min(color) as color from g group by 1), a as (select distinct color from g), more as (select c.query_id, cast(1 + row_number() over (partition by c.query_id order by md5('7:' || a.color), a.color) as int) as rank, a.color from c, a where a.color <> c.color qualify rank <= 3) select query_id, 1 as rank, color from c union all select * from more")
def fill_1(spark, sf_dir):
    """Colors filled up in a seeded order."""
    edges = flow(spark, sf_dir)
    chosen = edges.groupBy(F.col("src").alias("query_id")).agg(F.min("color").alias("color")).withColumn("rank", F.lit(1))
    return objectives.fill(chosen, chosen.select("query_id"), graph.colors(edges), 3)


@query(sql.minimum_cover(4, 5))
def sel_4(spark, sf_dir):
    """Minimum color covers of the walks of all pairs."""
    edges, solved = graph.identified(trade(spark, sf_dir)), objectives.by_pair(region_queries(spark, sf_dir))
    walks = paths.walk_edges(edges, solved.select("query_id", "sources", "targets"), 5).withColumn("path_id", F.col("rank").cast("long"))
    told = select.ordered_colors(graph.path_edges(walks, edges))
    routes = told.join(solved.select("query_id", "parent", "place"), "query_id").select(F.col("parent").alias("query_id"), F.col("place").alias("pair"), F.col("path_id").alias("rank"), "colors")
    return select.minimum_cover(routes, 4)


CELF = [*sql.BASE, sql.live(WORLDS), "seed as (select query_id, 0 as cand, t as s, t as node from (select 0 as query_id, unnest(targets) as t from q) group by all)", "allow as (select 0 as query_id, 0 as cand, color from g group by color)", sql.reach("", reverse=True)]


def _target_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = region_queries(spark, sf_dir).select(F.explode("targets").alias("node")).distinct()
    return influence.target_masks(trade(spark, sf_dir), to, WORLDS)


@query(sql.recursive(*CELF, "select v as node, count(*) as hits from reach group by 1"))
def celf_1(spark, sf_dir):
    """The spread of each node over the targets."""
    return influence.spreads(_target_masks(spark, sf_dir))


@query(sql.recursive(*CELF, "one as (select v, count(*) as gain from reach group by 1 order by 2 desc, 1 limit 1)", "two as (select r.v, count(*) as gain from reach r where (r.s, r.w) not in (select (s, w) from reach where v = (select v from one)) group by 1 order by 2 desc, 1 limit 1)", "select 1 as rank, v as node, gain as hits from one union all select 2, two.v, one.gain + two.gain from one, two where two.gain > 0"))
def celf_2(spark, sf_dir):
    """Two seeds by greedy gains."""
    return influence.seeds(_target_masks(spark, sf_dir), 2).drop("recounted")


@query()
def loop_1(spark, sf_dir):
    """Two rounds of seeds and colors in turn, for the targets of all regions."""
    to = region_queries(spark, sf_dir).select(F.explode("targets").alias("node")).distinct()
    return influence.alternate(trade(spark, sf_dir), to, 2, 2, 2, 10, WORLDS)


# parallel edges and exact probabilities --------------------------------------------------------------------------------

HOPS = 3
FLOW_LIVE = sql.live(WORLDS, sql.FLOW_KEY, keep="edge_id")
FLOW_WALKS = [sql.FLOW_SQL, sql.FLOW_QUERIES, *sql.flow_walks(10, HOPS)]


def _flow_queries(edges: DataFrame) -> DataFrame:
    """From each node divisible by 50 to the next node."""
    return flow_ends(edges).select("query_id", F.array("node").alias("sources"), F.array(F.col("node") + 1).alias("targets"))


def _flow_walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = graph.identified(flow(spark, sf_dir))
    walks = paths.walk_edges(edges, _flow_queries(edges), 10, HOPS)
    return edges, materialize(graph.path_edges(walks.withColumn("path_id", F.col("rank").cast("long")), edges), "walked")


@query(sql.recursive(*FLOW_WALKS, sql.FLOW_EDGES, f"select query_id, w.rank, w.cost, (select string_agg({sql.FLOW_KEY}, '|' order by position) from e where e.query_id = w.query_id and path_id = w.rank) as path from walk w"))
def sp_2_parallel(spark, sf_dir):
    """Walks on the event graph, parallel edges told apart."""
    edges = flow(spark, sf_dir)
    return paths.top_walks(edges, _flow_queries(edges), 10, HOPS).select("query_id", "rank", "cost", "path")


@query(sql.recursive(*FLOW_WALKS, sql.FLOW_EDGES, "select query_id, cast(path_id as bigint) as path_id, cast(position - 1 as int) as position, edge_id, src, dst, color from e"))
def gx_10_parallel(spark, sf_dir):
    """The edges of these walks, each the very one that was walked on."""
    return _flow_walked(spark, sf_dir)[1].drop("p", "coin")


@query(sql.recursive(*FLOW_WALKS, sql.FLOW_EDGES, FLOW_LIVE, "lv as (select distinct w, query_id, l.src, l.dst from e join live l using (edge_id) where l.color in (1, 2, 3))", "r8 as (select query_id, w, unnest(sources) as v from q, ws union select r.query_id, r.w, l.dst from r8 r join lv l on l.query_id = r.query_id and l.w = r.w and l.src = r.v)", "select q.query_id, count(distinct w) as hits from q join r8 on r8.query_id = q.query_id and list_contains(targets, v) group by 1"))
def mc_8_parallel(spark, sf_dir):
    """Reach within these walks under three colors, each parallel edge by its own coins."""
    edges, walked = _flow_walked(spark, sf_dir)
    asked = _flow_queries(edges)
    own = walked.where("color in (1, 2, 3)").select("query_id", F.lit(0).cast("long").alias("cand"), *graph.EDGE).distinct()
    scores = select._scored(own, asked, asked.select("query_id", F.lit(0).cast("long").alias("cand")), "sum", WORLDS)
    return scores.where("hits > 0").select("query_id", "hits")


@query(sql.recursive(*FLOW_WALKS, FLOW_LIVE, *sql.flow_greedy(3), "select query_id, rank, color, hits from picks"))
def obj_sum_h_parallel(spark, sf_dir):
    """Colors along these walks."""
    edges = flow(spark, sf_dir)
    return select.heuristic(edges, _flow_queries(edges), 3, 10, "sum", WORLDS, HOPS)


def _thin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph as text, with a tenth of its probabilities: 0.5 % and more."""
    return sinks.wide_lines(trade(spark, sf_dir).withColumn("p", F.col("p_pct") / 1000.0))


def _query_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_queries(spark, sf_dir).select(F.concat(joined("sources"), F.lit(";"), joined("targets")).alias("value"))


@query(sql.evaluate("sum", WORLDS, p=sql.THOUSANDTHS))
def src_1_exact(spark, sf_dir):
    """Probabilities below a percent, from text to an evaluation."""
    q = region_queries(spark, sf_dir)
    return objectives.evaluate(graph_text.wide_graph(_thin_lines(spark, sf_dir)), q, region_colors(q), "sum", WORLDS)


@query(sql.colors_of_lines(3, WORLDS))
def lines_b1(spark, sf_dir):
    """From graph and query lines to result lines, by baseline 1 and filled up."""
    return lines.colors_of_lines(_thin_lines(spark, sf_dir), _query_lines(spark, sf_dir), 3, "sum", "b1", worlds=WORLDS, seconds=0)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: the best colors for each pair of regions."""
    return QUERIES["obj_s_b1"](spark, sf_dir)
