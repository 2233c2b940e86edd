"""SQL for DuckDB that restates the driver queries, world by world in place of masks."""

from __future__ import annotations

from fogline.plans.fixtures import FLOW_SQL, QUERIES_SQL, TRADE_SQL

EDGE = "src || '>' || dst || '#' || color"


def recursive(*parts: str) -> str:
    """Common table expressions and the final select."""
    return "with recursive " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1]


def live(worlds: int, key: str = EDGE, p: str = "p_pct / 100.0::double", keep: str = "") -> str:
    """The edges that exist in each world: each coin of an edge gives the gap to the next one. ``keep`` names further columns."""
    more = f", {keep}" if keep else ""
    u = "(cast('0x' || substr(md5((i + 1) || ':' || key), 1, 8) as bigint) + 0.5) / 4294967296.0::double"
    gap = f"case when p >= 1 then 0 else least(floor(ln({u}) / ln(1.0::double - p)), {worlds}) end"
    return f"""
ws as (select unnest(generate_series(0, {worlds - 1})) as w),
gaps as (
  select src, dst, color{more}, {key} as key, p, 0 as i, -1::bigint as w from (select *, {p} as p from g) where p > 0
  union all
  select src, dst, color{more}, key, p, i + 1, w + 1 + cast({gap} as bigint) from gaps where w < {worlds}),
live as materialized (select w, src, dst, color{more} from gaps where w between 0 and {worlds - 1})"""


def live_undirected(worlds: int) -> str:
    """The same where the arcs of an edge share a coin and both lead on where one of them exists."""
    key = "least(src, dst) || '>' || greatest(src, dst) || '#' || color"
    return live(worlds, key).replace("live as materialized (", "live1 as materialized (") + ",\nlive as (select * from live1 union select w, dst, src, color from live1)"


def reach(x: str, reverse: bool = False) -> str:
    """Closure over live edges from seed{x} (query_id, cand, s, node) with the colors allow{x} (query_id, cand, color)."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return f"""
reach{x} as (
  select query_id, cand, s, w, node as v from seed{x}, ws
  union
  select r.query_id, r.cand, r.s, r.w, l.{b} from reach{x} r join live l on l.w = r.w and l.{a} = r.v
  join allow{x} a on a.query_id = r.query_id and a.cand = r.cand and a.color = l.color)"""


def score(objective: str, x: str = "", queries: str = "q") -> list[str]:
    """score{x} (query_id, cand, hits) of cand{x} with allow{x}."""
    if objective == "s":
        return [f"qs{x} as (select query_id, [list_min(sources)] as sources, [list_min(targets)] as targets from {queries})", *score("max", x, f"qs{x}")]
    ends = f"(select query_id, unnest(targets) as t from {queries})"
    if objective in ("sum", "rel"):
        seed = f"seed{x} as (select c.query_id, cand, 0 as s, node from cand{x} c join (select query_id, unnest(sources) as node from {queries}) k on k.query_id = c.query_id)"
        what = "count(distinct w)" if objective == "sum" else "count(*)"
        hits = f"h{x} as (select r.query_id, cand, {what} as hits from reach{x} r join {ends} e on e.query_id = r.query_id and e.t = r.v group by 1, 2)"
    elif objective == "conn":
        every = f"(select distinct query_id, unnest(list_concat(sources, targets)) as t from {queries})"
        seed = f"seed{x} as (select c.query_id, cand, k.t as s, k.t as node from cand{x} c join {every} k on k.query_id = c.query_id)"
        hits = f"""
ev{x} as (select r.query_id, cand, s, w, count(distinct v) as got from reach{x} r join {every} e on e.query_id = r.query_id and e.t = r.v group by 1, 2, 3, 4),
h{x} as (
  select query_id, cand, max(n) as hits from (
    select a.query_id, cand, s, count(*) as n from ev{x} a
    join (select query_id, count(*) as k from {every} group by 1) z on z.query_id = a.query_id where got = k group by 1, 2, 3) group by 1, 2)"""
    else:
        seed = f"seed{x} as (select c.query_id, cand, s, s as node from cand{x} c join (select query_id, unnest(sources) as s from {queries}) k on k.query_id = c.query_id)"
        how = {"max": "max", "min": "min", "avg": "sum"}[objective]
        hits = f"""
p{x} as (select c.query_id, cand, s, t from cand{x} c join (select query_id, unnest(sources) as s from {queries}) k on k.query_id = c.query_id join {ends} e on e.query_id = c.query_id where s <> t),
ph{x} as (select p.query_id, p.cand, p.s, p.t, count(r.w) as hits from p{x} p left join reach{x} r on r.query_id = p.query_id and r.cand = p.cand and r.s = p.s and r.v = p.t group by 1, 2, 3, 4),
h{x} as (select query_id, cand, {how}(hits) as hits from ph{x} group by 1, 2)"""
    return [seed, reach(x), hits, f"score{x} as (select c.query_id, c.cand, cast(coalesce(hits, 0) as bigint) as hits from cand{x} c left join h{x} h on h.query_id = c.query_id and h.cand = c.cand)"]


BASE = [TRADE_SQL, QUERIES_SQL]
COLORS = "colors as (select distinct color from g)"
CHOSEN = "chosen as (select query_id, unnest([query_id % 5 + 1, (query_id + 2) % 5 + 1]) as color from q)"


def evaluate(objective: str, worlds: int, p: str = "p_pct / 100.0::double") -> str:
    cand = "cand as (select query_id, 0 as cand from q)"
    return recursive(*BASE, CHOSEN, live(worlds, p=p), cand, "allow as (select query_id, 0 as cand, color from chosen)", *score(objective), f"select query_id, hits, cast({worlds} as bigint) as worlds from score")


def _first(queries: str) -> list[str]:
    return [f"cand as (select query_id, color as cand from {queries}, colors)", "allow as (select query_id, cand, cand as color from cand)"]


PAIRS = "qp as (select row_number() over (order by parent, s, t) as query_id, parent, s, t, [s] as sources, [t] as targets from (select query_id as parent, unnest(sources) as s, targets from q) a, lateral (select unnest(targets)) b(t) where s <> t)"


def baseline1(objective: str, k: int, worlds: int) -> str:
    if objective == "max":
        top = f"top as (select *, row_number() over (partition by query_id order by hits desc, cand) as rank from score where hits > 0 qualify rank <= {k})"
        best = "best as (select parent, arg_max(query_id, (worth, s, t)) as query_id from (select query_id, sum(hits) as worth from top group by 1) join qp using (query_id) group by 1)"
        return recursive(*BASE, COLORS, PAIRS, live(worlds), *_first("qp"), *score("s", "", "qp"), top, best, "select parent as query_id, cast(rank as int) as rank, cand as color, hits from top join best using (query_id)")
    final = f"select query_id, cast(rank as int) as rank, cand as color, hits from (select *, row_number() over (partition by query_id order by hits desc, cand) as rank from score where hits > 0) where rank <= {k}"
    return recursive(*BASE, COLORS, live(worlds), *_first("q"), *score(objective), final)


def baseline2(objective: str, worlds: int) -> str:
    """Two rounds."""
    queries, inner = ("qp", "s") if objective == "max" else ("q", objective)
    pick = lambda x: f"pick{x} as (select query_id, cand as color, hits from score{x} qualify row_number() over (partition by query_id order by hits desc, cand) = 1)"
    second = [
        "cand2 as (select c.query_id, c.cand from cand c join pick p on p.query_id = c.query_id where c.cand <> p.color)",
        "allow2 as (select query_id, cand, cand as color from cand2 union all select c.query_id, c.cand, p.color from cand2 c join pick p on p.query_id = c.query_id)",
    ]
    both = "both_rounds as (select query_id, 1 as rank, color, hits from pick union all select query_id, 2, color, hits from pick2)"
    parts = [*BASE, COLORS, *([PAIRS] if objective == "max" else []), live(worlds), *_first(queries), *score(inner, "", queries), pick(""), *second, *score(inner, "2", queries), pick("2"), both]
    if objective == "max":
        best = "best as (select parent, arg_max(query_id, (worth, s, t)) as query_id from (select query_id, max(hits) as worth from both_rounds group by 1) join qp using (query_id) group by 1)"
        return recursive(*parts, best, "select parent as query_id, rank, color, hits from both_rounds join best using (query_id)")
    return recursive(*parts, "select * from both_rounds")


#: The least source and the least target of each query.
ONE = "q1 as (select query_id, [list_min(sources)] as sources, [list_min(targets)] as targets from q)"
COST = "cast(floor(-ln(p_pct / 100.0::double) * 1000.0) as bigint)"
ARCS = f"arcs as (select src, dst, color, {COST} as cost, {EDGE} as edge from g where p_pct > 0)"


def walks(r: int, queries: str = "q", backtrack: bool = False) -> list[str]:
    """walk (query_id, rank, cost, path): walks of any length. No walk that costs more than the r-th of those of up to two edges is
    among the r cheapest, and every edge costs something, so that ends the recursion."""
    back = "" if backtrack else "and (b.prev is null or a.dst <> b.prev)"
    head = f"select query_id, s as node, null::bigint as prev, 0::bigint as cost, '' as path, 0 as h, targets, false as arrived from (select query_id, unnest(sources) as s, targets from {queries}) where not list_contains(targets, s)"
    on = "select b.query_id, a.dst, b.node, b.cost + a.cost, case when b.path = '' then a.edge else b.path || '|' || a.edge end, b.h + 1, b.targets, list_contains(b.targets, a.dst)"
    return [
        f"short as ({head} union all {on} from short b join arcs a on a.src = b.node where b.h < 2 and not b.arrived {back})",
        f"bound as (select query_id, case when count(*) >= {r} then max(cost) end as most from (select query_id, cost from short where arrived qualify row_number() over (partition by query_id order by cost) <= {r}) group by 1)",
        f"step as ({head} union all {on} from step b join arcs a on a.src = b.node join bound m on m.query_id = b.query_id where b.cost + a.cost <= m.most and not b.arrived {back})",
        f"walk as (select query_id, cast(row_number() over (partition by query_id order by cost, path) as int) as rank, cost, path from step where arrived qualify rank <= {r})",
    ]


def greedy(objective: str, k: int, queries: str = "q") -> list[str]:
    """picks (query_id, rank, color, hits): k rounds of the greedy choice along walk, for sum or rel. Of a round, st has what each path
    lacks, tk the paths that need nothing, c the candidates, le the edges of each, r the nodes that they reach, pk the best."""
    parts = [
        "e as materialized (select query_id, rank as path_id, position, src, dst, color from (select query_id, rank, unnest(string_split(path, '|')) as label, generate_subscripts(string_split(path, '|'), 1) as position from walk) x "
        f"join (select *, {EDGE} as edge from g) g on g.edge = label)",
        "rest0 as (select query_id, path_id, list(color order by first) as colors, cast([] as bigint[]) as chosen from (select query_id, path_id, color, min(position) as first from e group by 1, 2, 3) group by 1, 2)",
        "taken0 as (select query_id, path_id from rest0 where false)",
    ]
    hits = "count(distinct w)" if objective == "sum" else "count(*)"
    for i in range(1, k + 1):
        parts += [
            f"st{i} as materialized (select *, list_filter(colors, lambda x: not list_contains(chosen, x)) as new from rest{i - 1})",
            f"tk{i} as materialized (select * from taken{i - 1} union all select query_id, path_id from st{i} where len(new) = 0)",
            f"c{i} as materialized (select query_id, path_id as cand, colors, chosen, new from st{i} where len(new) > 0 and len(chosen) + len(new) <= {k})",
            f"le{i} as materialized (select query_id, cand, src, dst, color from c{i} join e using (query_id) where e.path_id = cand union select query_id, cand, src, dst, color from c{i} join tk{i} using (query_id) join e using (query_id, path_id))",
            f"r{i} as (select query_id, cand, w, unnest(sources) as v from c{i} join {queries} using (query_id), ws union select r.query_id, r.cand, r.w, l.dst from r{i} r join le{i} x on x.query_id = r.query_id and x.cand = r.cand and x.src = r.v "
            "join live l on l.w = r.w and l.src = x.src and l.dst = x.dst and l.color = x.color)",
            f"h{i} as materialized (select query_id, cand, {hits} as hits from r{i} join {queries} using (query_id) where list_contains(targets, v) group by 1, 2)",
            f"pk{i} as materialized (select query_id, cand, chosen, new, coalesce(hits, 0) as hits from c{i} left join h{i} using (query_id, cand) qualify row_number() over (partition by query_id order by coalesce(hits, 0) desc, cand) = 1)",
            f"taken{i} as (select * from tk{i} union all select query_id, cand from pk{i})",
            f"rest{i} as (select c.query_id, c.cand as path_id, c.colors, list_concat(p.chosen, p.new) as chosen from c{i} c join pk{i} p on p.query_id = c.query_id and p.cand <> c.cand)",
        ]
    each = " union all ".join(f"select query_id, {i} as turn, len(chosen) + generate_subscripts(new, 1) as rank, unnest(new) as color, hits from pk{i}" for i in range(1, k + 1))
    parts += [
        f"tkz as materialized (select * from taken{k} union all select query_id, path_id from rest{k} where len(list_filter(colors, lambda x: not list_contains(chosen, x))) = 0)",
        f"cz as materialized (select distinct query_id, 0 as cand from ({each}))",
        "lez as materialized (select distinct query_id, cand, src, dst, color from cz join tkz using (query_id) join e using (query_id, path_id))",
        f"rz as (select query_id, cand, w, unnest(sources) as v from cz join {queries} using (query_id), ws union select r.query_id, r.cand, r.w, l.dst from rz r join lez x on x.query_id = r.query_id and x.cand = r.cand and x.src = r.v "
        "join live l on l.w = r.w and l.src = x.src and l.dst = x.dst and l.color = x.color)",
        f"hz as materialized (select query_id, {hits} as final from rz join {queries} using (query_id) where list_contains(targets, v) group by 1)",
    ]
    told = f"select query_id, rank, color, case when turn = max(turn) over (partition by query_id) then coalesce(final, 0) else hits end as hits from ({each}) left join hz using (query_id)"
    return [*parts, f"picks as materialized (select query_id, cast(rank as int) as rank, color, cast(hits as bigint) as hits from ({told}))"]


def heuristic(objective: str, k: int, r: int, worlds: int) -> str:
    """For all objectives but conn."""
    if objective == "min":
        return max_min(k, r, worlds)
    head = [*BASE, ARCS, live(worlds)]
    if objective == "max":
        best = "best as (select parent, arg_max(query_id, (worth, s, t)) as query_id from (select query_id, max(hits) as worth from picks group by 1) join qp using (query_id) group by 1)"
        return recursive(*head, PAIRS, *walks(r, "qp"), *greedy("sum", k, "qp"), best, "select parent as query_id, rank, color, hits from picks join best using (query_id)")
    final = "select query_id, rank, color, hits from picks"
    if objective == "avg":
        pooled = "walk as (select query_id, cast(row_number() over (partition by query_id order by cost, path) as int) as rank, cost, path from (select distinct parent as query_id, cost, path from each_walk join qp using (query_id)))"
        each = [x.replace("walk as (", "each_walk as (", 1) if x.startswith("walk as (") else x for x in walks(r, "qp")]
        return recursive(*head, PAIRS, *each, pooled, *greedy("sum", k), final)
    if objective == "s":
        return recursive(*head, ONE, *walks(r, "q1"), *greedy("sum", k, "q1"), final)
    return recursive(*head, *walks(r), *greedy(objective, k), final)


#: The edges and the colors of the walks of each pair, and the queries that have walks for all their pairs.
ROUTES = [
    "e as materialized (select query_id as pair, rank, position, src, dst, color from (select query_id, rank, unnest(string_split(path, '|')) as label, generate_subscripts(string_split(path, '|'), 1) as position from walk) x "
    f"join (select *, {EDGE} as edge from g) g on g.edge = label)",
    "routes as materialized (select parent as query_id, pair, rank, list(color order by first) as colors from (select pair, rank, color, min(position) as first from e group by 1, 2, 3) join qp on qp.query_id = pair group by 1, 2, 3)",
]


def cover(k: int) -> list[str]:
    """covered (query_id, chosen) of routes. A step takes the next path, or drops a color while there are more than k: pend is the pair
    whose path was taken and that isn't done yet."""
    fresh = "len(list_filter(p.colors, lambda c: not list_contains(chosen, c)))"
    kept = "len(list_filter(paths, lambda p: p.pair = d and len(list_filter(p.colors, lambda x: x = c or not list_contains(chosen, x))) = 0))"
    spare = f"list_filter(list_sort(chosen), lambda c: not list_contains(needs, c) and len(list_filter(done, lambda d: {kept} = 0)) = 0)"
    return [
        "every as (select query_id, list({'pair': pair, 'colors': colors} order by rank, pair) as paths, count(distinct pair) as n from routes group by 1)",
        f"""
cover as (
  select query_id, paths, n, cast([] as bigint[]) as chosen, cast([] as bigint[]) as done, cast(null as bigint) as pend, cast([] as bigint[]) as needs, false as dead from every
  union all
  select query_id, paths, n, now, case when len(now) <= {k} and not stuck then list_append(done, taken) else done end,
         case when len(now) > {k} then taken end, wants, stuck
  from (
    select *, case when pend is null then list_distinct(list_concat(chosen, next.colors)) else list_filter(chosen, lambda c: c <> spare[1]) end as now,
           coalesce(pend, next.pair) as taken, case when pend is null then next.colors else needs end as wants, pend is not null and len(spare) = 0 as stuck
    from (
      select *, rest[list_position(costs, list_min(costs))] as next, {spare} as spare
      from (
        select *, list_transform(rest, lambda p: {fresh}) as costs
        from (select *, list_filter(paths, lambda p: not list_contains(done, p.pair)) as rest from cover where not dead and len(done) < n))))),
covered as materialized (select query_id, chosen from cover where len(done) = n and not dead)""",
    ]


def minimum_cover(k: int, r: int) -> str:
    return recursive(*BASE, ARCS, PAIRS, *walks(r, "qp"), *ROUTES, *cover(k), "select query_id, unnest(chosen) as color from covered")


def max_min(k: int, r: int, worlds: int) -> str:
    """A cover of the queries whose pairs all have walks, then up to k rounds for the worst pair."""

    def hits(x: str) -> list[str]:
        """h{x} of c{x} (query_id, cand, pair, cols): worlds in which the pair's walks under the colors cols lead from its source to its target."""
        return [
            f"x{x} as materialized (select distinct query_id, cand, pair, src, dst, color from c{x} join e using (pair) where list_contains(cols, color))",
            f"r{x} as (select c.query_id, cand, pair, w, s as v from c{x} c join qp on qp.query_id = pair, ws union select r.query_id, r.cand, r.pair, r.w, l.dst from r{x} r join x{x} x on x.query_id = r.query_id and x.cand = r.cand and x.pair = r.pair and x.src = r.v "
            "join live l on l.w = r.w and l.src = x.src and l.dst = x.dst and l.color = x.color)",
            f"h{x} as materialized (select c.query_id, c.cand, c.pair, coalesce(n, 0) as hits from c{x} c left join (select r.query_id, cand, pair, count(*) as n from r{x} r join qp on qp.query_id = pair where v = t group by 1, 2, 3) using (query_id, cand, pair))",
        ]

    parts = [*BASE, ARCS, live(worlds), PAIRS, *walks(r, "qp"), *[x.replace("routes as", "ways as") for x in ROUTES]]
    parts += ["routes as materialized (select * from ways where query_id not in (select parent from qp where query_id not in (select pair from ways)))", *cover(k), "set0 as (select query_id, chosen as have from covered where len(chosen) > 0)"]
    for i in range(1, k + 1):
        parts += [
            f"ca{i} as materialized (select distinct query_id, 0 as cand, pair, have as cols from routes join set{i - 1} using (query_id) where len(have) < {k})",
            *hits(f"a{i}"),
            f"worst{i} as (select query_id, arg_min(pair, (hits, pair)) as pair from ha{i} group by 1)",
            f"cb{i} as materialized (select query_id, rank as cand, pair, list_distinct(list_concat(have, colors)) as cols from routes join worst{i} using (query_id, pair) join set{i - 1} using (query_id) where len(list_distinct(list_concat(have, colors))) between len(have) + 1 and {k})",
            *hits(f"b{i}"),
            f"best{i} as (select query_id, cand from hb{i} qualify row_number() over (partition by query_id order by hits desc, cand) = 1)",
            f"set{i} as materialized (select s.query_id, coalesce(cols, have) as have from set{i - 1} s left join (select query_id, cols from cb{i} join best{i} using (query_id, cand)) using (query_id))",
        ]
    parts += [f"cz as materialized (select s.query_id, 0 as cand, qp.query_id as pair, have as cols from set{k} s join qp on parent = s.query_id)", *hits("z")]
    parts.append(f"told as (select query_id, unnest(list_sort(have)) as color, generate_subscripts(have, 1) as rank from set{k})")
    return recursive(*parts, "select query_id, cast(rank as int) as rank, color, cast(hits as bigint) as hits from told join (select query_id, min(hits) as hits from hz group by 1) using (query_id)")


#: Least cost from each node to each other, over up to 24 edges.
DIST = """
steps as (
  select t as target, t as node, 0::bigint as dist, 0 as h from (select dst as t from arcs union select unnest(targets) from q)
  union all
  select target, src, min(dist + cost), h + 1 from steps join arcs on dst = node where h < 24 group by target, src, h),
dist as (select target, node, min(dist) as dist from steps group by 1, 2)"""
ENDS = "ends as (select distinct list_min(targets) as target from q)"
PARENT = "parent as (select d.target, d.node, d.dist, case when d.dist > 0 then (select min(edge) from arcs a join dist v on v.target = d.target and v.node = a.dst where a.src = d.node and a.cost + v.dist = d.dist) end as parent from dist d join ends on ends.target = d.target)"
PENALTY = "pen as (select a.target, e.src, e.dst, e.color, e.edge, v.dist + e.cost - a.dist as penalty from arcs e join dist a on a.node = e.src join dist v on v.target = a.target and v.node = e.dst join ends on ends.target = a.target)"



def steiner(directed: bool = True) -> str:
    """Least cost of a tree over all terminals of a query to each root: sets of 1, 2, ... 5 terminals, merged at a node, then led on."""
    arcs = [ARCS] if directed else [ARCS.replace("arcs as (", "arc1 as ("), "arcs as (select * from arc1 union all select dst, src, color, cost, edge from arc1)"]
    parts = [
        *BASE, *arcs, DIST,
        "d as (select node as a, target as b, dist from dist union select distinct src, src, 0 from arcs)",
        "t as (select query_id, t, row_number() over (partition by query_id order by t) - 1 as bit from (select distinct query_id, unnest(list_concat(sources, targets)) as t from q))",
        "whole as (select query_id, cast((1 << count(*)) - 1 as bigint) as whole from t group by 1)",
        "t1 as (select query_id, cast(1 << bit as bigint) as mask, d.b as v, min(d.dist) as cost from t join d on d.a = t.t group by 1, 2, 3)",
        "s1 as (select * from t1)",
    ]
    for k in range(2, 6):
        parts.append(f"m{k} as (select x.query_id, x.mask | y.mask as mask, x.v, min(x.cost + y.cost) as cost from s{k - 1} x join s{k - 1} y on x.query_id = y.query_id and x.v = y.v and x.mask & y.mask = 0 and x.mask < y.mask where bit_count(x.mask | y.mask) = {k} group by 1, 2, 3)")
        parts.append(f"s{k} as (select * from s{k - 1} union all select query_id, mask, d.b as v, min(m.cost + d.dist) as cost from m{k} m join d on d.a = m.v group by 1, 2, 3)")
    return recursive(*parts, "select s.query_id, v as node, cast(min(cost) as bigint) as cost from s5 s join whole w on w.query_id = s.query_id and mask = whole group by 1, 2")


FLOW_KEY = EDGE + " || '@' || edge_id"


def flow_reach(worlds: int, reverse: bool = False) -> list[str]:
    """Closure from the nodes divisible by 50 over all colors of the event graph."""
    seeds = "seed as (select distinct src as query_id, 0 as cand, 0 as s, src as node from g where src % 50 = 0)"
    allow = "allow as (select query_id, 0 as cand, color from seed, (select distinct color from g))"
    return [FLOW_SQL, live(worlds, FLOW_KEY), seeds, allow, reach("", reverse)]


#: From each node divisible by 50 of the event graph, the next node as its target.
FLOW_QUERIES = "q as (select distinct src as query_id, [src] as sources, [src + 1] as targets from g where src % 50 = 0)"
#: The edges of walks, with parallel ones told apart.
FLOW_EDGES = "e as materialized (select query_id, rank as path_id, position, g.edge_id, src, dst, color, p_pct from (select query_id, rank, unnest(edges) as edge_id, generate_subscripts(edges, 1) as position from walk) x join g using (edge_id))"


def flow_walks(r: int, hops: int) -> list[str]:
    """walk (query_id, rank, cost, edges) of up to ``hops`` edges on the event graph, whose parallel edges are edges of their own."""
    return [
        f"arcs as (select src, dst, edge_id, {COST} as cost from g where p_pct > 0)",
        f"""
step as (
  select query_id, s as node, null::bigint as prev, 0::bigint as cost, []::bigint[] as edges, targets, false as arrived
  from (select query_id, unnest(sources) as s, targets from q) where not list_contains(targets, s)
  union all
  select b.query_id, a.dst, b.node, b.cost + a.cost, list_append(b.edges, a.edge_id), b.targets, list_contains(b.targets, a.dst)
  from step b join arcs a on a.src = b.node where len(b.edges) < {hops} and not b.arrived and (b.prev is null or a.dst <> b.prev))""",
        f"walk as materialized (select query_id, cast(row_number() over (partition by query_id order by cost, edges) as int) as rank, cost, edges from step where arrived qualify rank <= {r})",
    ]


def flow_greedy(k: int) -> list[str]:
    """greedy() on the event graph, by edge ids."""
    parts = [FLOW_EDGES, *greedy("sum", k)[1:]]
    parts = [x.replace("cand, src, dst, color from c", "cand, edge_id, src, dst, color from c") for x in parts]
    return [x.replace("l.src = x.src and l.dst = x.dst and l.color = x.color", "l.edge_id = x.edge_id") for x in parts]


#: A probability that isn't a whole percent.
THOUSANDTHS = "p_pct / 1000.0::double"


def colors_of_lines(k: int, worlds: int) -> str:
    """Baseline 1 for sum, filled up, as result lines."""
    top = f"top as materialized (select query_id, cand as color, row_number() over (partition by query_id order by hits desc, cand) as rank from score where hits > 0 qualify rank <= {k})"
    more = "more as (select q.query_id, color, (select count(*) from top t where t.query_id = q.query_id) + row_number() over (partition by q.query_id order by md5('7:' || color), color) as rank from q, colors where not exists (select 1 from top t where t.query_id = q.query_id and t.color = colors.color))"
    line = f"array_to_string(sources, ' ') || ';' || array_to_string(targets, ' ') || '; ' || string_agg(color::varchar, ' ' order by rank) || '; ' || (select count(*) from top t where t.query_id = q.query_id) || '; Loop: {worlds}; Time: 0'"
    return recursive(*BASE, COLORS, live(worlds, p=THOUSANDTHS), *_first("q"), *score("sum"), top, more, f"select {line} as value from q join (select query_id, color, rank from top union all select * from more where rank <= {k}) using (query_id) group by q.query_id, sources, targets")
