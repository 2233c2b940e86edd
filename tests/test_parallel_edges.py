"""Graphs with parallel edges of one color, probabilities that aren't whole percents, and the road from text to text."""

import itertools
import math

import pytest

from fogline.operators import graph, influence, objectives, paths, reach, select, steiner
from fogline.plans import lines
from tests.test_graph import QUERY, exact, worlds_of

EDGES = "src long, dst long, color long, p double, edge_id long"
TWIN = [(1, 2, 1, 0.3, 10), (1, 2, 1, 0.3, 11)]
#: Two edges of one color and cost between 2 and 3, and a way around.
ROWS = [(1, 2, 1, 0.9, 1), (2, 3, 1, 0.5, 2), (2, 3, 1, 0.5, 3), (2, 3, 2, 0.41, 4), (1, 3, 3, 0.2, 5), (3, 4, 1, 0.75, 6), (3, 4, 1, 0.333, 7), (4, 2, 2, 0.6, 8), (1, 4, 2, 0.07, 9)]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def query_of(spark, s, t):
    return spark.createDataFrame([(0, s, t)], QUERY)


def brute_walks(rows, s, t, r, hops):
    found, opened = [], [(0, [], s, None)]
    while opened:
        cost, ids, node, prev = opened.pop()
        for a, b, _, p, i in rows:
            if a == node and b != prev and len(ids) < hops:
                step = (cost + math.floor(-math.log(p) * 1000), [*ids, i])
                if b == t:
                    found.append(step)
                else:
                    opened.append((*step, b, node))
    return sorted(found)[:r]


def test_two_parallel_edges_count_as_two(spark):
    worlds = 4096
    df, q = edges_of(spark, TWIN), query_of(spark, [1], [2])
    chosen = spark.createDataFrame([(0, 1)], "query_id long, color long")
    evaluated = objectives.evaluate(df, q, chosen, "s", worlds).first()["hits"]
    assert evaluated == len(worlds_of("1>2#1@10", 0.3, worlds) | worlds_of("1>2#1@11", 0.3, worlds))
    assert abs(evaluated - 0.51 * worlds) < 3 * (worlds * 0.51 * 0.49) ** 0.5
    for objective in ("s", "sum", "avg", "max", "min", "rel"):
        assert [(r["color"], r["hits"]) for r in select.heuristic(df, q, 1, 5, objective, worlds).collect()] == [(1, evaluated)]
    # a tree has one of the two edges only
    assert select.heuristic(df, q, 1, 5, "conn", worlds).first()["hits"] == len(worlds_of("1>2#1@10", 0.3, worlds))


def test_walks_tell_parallel_edges_apart(spark):
    df = edges_of(spark, ROWS)
    for r, hops in ((6, 3), (12, 4)):
        got = paths.top_walks(df, query_of(spark, [1], [4]), r, hops).orderBy("rank").collect()
        assert [(x["cost"], x["edges"]) for x in got] == brute_walks(ROWS, 1, 4, r, hops)
    label = {i: f"{a}>{b}#{c}@{i}" for a, b, c, _, i in ROWS}
    assert [x["path"] for x in got] == ["|".join(label[i] for i in x["edges"]) for x in got]
    unlimited = paths.top_walks(df, query_of(spark, [1], [4]), 5).orderBy("rank").collect()
    assert [(x["cost"], x["edges"]) for x in unlimited] == brute_walks(ROWS, 1, 4, 5, 7)
    walked = graph.path_edges(paths.top_walks(df, query_of(spark, [1], [4]), 6, 3).withColumnRenamed("rank", "path_id"), df).collect()
    told = {(x["path_id"], x["position"]): x["edge_id"] for x in walked}
    assert len(told) == len(walked) and told == {(k + 1, p): i for k, (_, ids) in enumerate(brute_walks(ROWS, 1, 4, 6, 3)) for p, i in enumerate(ids)}


def test_side_tracks_of_parallel_edges(spark):
    df = edges_of(spark, ROWS)
    dist = paths.distances(df, spark.createDataFrame([(3,)], "target long"))
    assert {r["node"]: r["parent"] for r in dist.collect()} == {3: None, 2: 2, 1: 1, 4: 8}
    side = [(r["src"], r["edge_id"], r["rank"]) for r in paths.side_tracks(df, dist, 5).where("src = 2").orderBy("rank").collect()]
    assert side == [(2, 3, 1), (2, 4, 2)]


def brute_trees(rows, terminals, directed):
    """Least cost and, of those, the least sorted edge ids of an edge set in which all terminals lead to a root."""
    best = {}
    for n in range(len(rows) + 1):
        for some in itertools.combinations(rows, n):
            cost = sum(math.floor(-math.log(r[3]) * 1000) for r in some)
            ids = sorted(r[4] for r in some)
            arcs = [(r[0], r[1]) for r in some] + ([] if directed else [(r[1], r[0]) for r in some])
            for root in {x for r in rows for x in r[:2]}:
                seen, grown = {root}, True
                while grown:
                    new = {a for a, b in arcs if b in seen} - seen
                    seen |= new
                    grown = bool(new)
                if set(terminals) <= seen and (root not in best or (cost, ids) < best[root]):
                    best[root] = (cost, ids)
    return best


@pytest.mark.parametrize("directed", [True, False])
def test_trees_equal_brute_force(spark, directed):
    terminals = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "query_id long, node long")
    want = brute_trees(ROWS, [1, 2, 3], directed)
    states = steiner.tree_states(edges_of(spark, ROWS), terminals, directed).where("mask = 7").collect()
    assert {r["node"]: r["cost"] for r in states} == {k: v[0] for k, v in want.items()}
    top = steiner.top_trees(edges_of(spark, ROWS), terminals, 3, directed).orderBy("rank").collect()
    assert (top[0]["cost"], top[0]["edges"]) == min(want.values())
    assert len({tuple(r["edges"]) for r in top}) == len(top)


def test_undirected_edges_have_one_coin_in_trees(spark):
    """Trees grow towards a root, but both arcs of their edges lead on."""
    star = [(0, 1, 1, 0.9, 1), (0, 2, 1, 0.9, 2), (0, 2, 1, 0.4, 3)]
    got = select.heuristic(edges_of(spark, star), query_of(spark, [1], [2]), 1, 3, "conn", 2048, directed=False).first()
    alive = [worlds_of(f"0>{b}#1@{i}", p, 2048) for _, b, _, p, i in star]
    assert got["hits"] == len(alive[0] & alive[1])


@pytest.mark.parametrize("p", [0.001, 0.0004, 0.0173, 0.5, 0.999, 1.0, 1.5])
def test_chances_of_any_size(spark, p):
    worlds, rows = 20_000, [(k, k + 1, 1, p, k) for k in range(6)]
    got = {r["src"]: 0 for r in edges_of(spark, rows).collect()}
    for r in reach.edge_masks(edges_of(spark, rows), worlds).collect():
        got[r["src"]] += bin(r["em"] & (1 << 64) - 1).count("1")
    assert got == {k: len(worlds_of(f"{k}>{k + 1}#1@{k}", min(p, 1.0), worlds)) for k in range(6)}
    n, chance = 6 * worlds, min(p, 1.0)
    assert abs(sum(got.values()) - n * chance) <= 4.5 * (n * chance * (1 - chance)) ** 0.5


def test_edges_that_never_exist(spark):
    rows = [(1, 2, 1, 0.0, 1), (1, 2, 1, -0.5, 2), (1, 2, 1, None, 3)]
    assert reach.edge_masks(edges_of(spark, rows), 100).count() == 0
    assert paths.top_walks(edges_of(spark, rows), query_of(spark, [1], [2]), 3).count() == 0


def test_doubles_and_whole_percents_agree(spark):
    rows = [(1, 2, 1, 37), (2, 3, 2, 80), (1, 3, 3, 5)]
    whole = spark.createDataFrame(rows, "src long, dst long, color long, p_pct long")
    exact_p = whole.selectExpr("src", "dst", "color", "p_pct / 100.0d as p")
    masks = [sorted(map(tuple, reach.edge_masks(df, 300, quantise=q).collect())) for df in (whole, exact_p) for q in (None, 10)]
    assert masks[0] == masks[2] and masks[1] == masks[3]
    q = query_of(spark, [1], [3])
    assert [tuple(r) for r in paths.top_walks(whole, q, 3).orderBy("rank").collect()] == [tuple(r) for r in paths.top_walks(exact_p, q, 3).orderBy("rank").collect()]
    assert abs(influence.collapse(spark.createDataFrame([(1, 2, 1, 0.001, 1), (1, 2, 1, 0.002, 2)], EDGES)).first()["p"] - (1 - 0.999 * 0.998)) < 1e-15


def test_decided_worlds_leave_the_frontier(spark, monkeypatch):
    """Behind the target stands a long chain; an evaluation ends when the target's worlds are decided, with the same hits."""
    rows = [(1, 2, 1, 0.999999, 1), *((k, k + 1, 1, 1.0, k) for k in range(2, 40))]
    df, chosen = edges_of(spark, rows), spark.createDataFrame([(0, 1)], "query_id long, color long")
    written = []
    real = reach.Buckets.write
    monkeypatch.setattr(reach.Buckets, "write", lambda self, *a: written.append(1) or real(self, *a))
    for objective in ("s", "sum", "rel", "max", "min"):
        written.clear()
        assert objectives.evaluate(df, query_of(spark, [1], [3]), chosen, objective, 64).first()["hits"] == 64
        assert len(written) <= 5
    masks = reach.edge_masks(df, 64)
    written.clear()
    whole = reach.reach(masks, reach.start(spark.createDataFrame([(1,)], "node long"), 64), [])
    assert whole.count() == 40 and len(written) >= 40


def test_from_lines_to_lines(spark):
    graph_lines = spark.createDataFrame([("1 2 0.5 1 0.001 2",), ("2 4 0.5 1",), ("1 3 0.9 2",), ("3 4 0.9 2",), ("7 8 0.1 3",)], "value string")
    asked = spark.createDataFrame([("1;4",), ("1;4",), ("1 1;4 3",), ("1;99",), ("",)], "value string")
    rows = [(1, 2, 1, 50), (1, 2, 2, 0.1), (2, 4, 1, 50), (1, 3, 2, 90), (3, 4, 2, 90)]
    for strategy in lines.STRATEGIES:
        got = sorted(r["value"] for r in lines.colors_of_lines(graph_lines, asked, 3, "sum", strategy, worlds=256, seconds=7).collect())
        assert [x.split("; ")[0] for x in got] == ["1;3 4", "1;4"]
        assert all(sorted(x.split("; ")[1].split()) == ["1", "2", "3"] and x.endswith("; Loop: 256; Time: 7") for x in got)
    told = spark.createDataFrame([("1;4; 2; 1; Loop: 256; Time: 7",), ("1;4; 1 2; 2; Loop: 256; Time: 7",)], "value string")
    got = {r["value"] for r in lines.evaluation_of_lines(graph_lines, told, "s", 2048, seconds=0).collect()}
    for line in got:
        colors = [int(c) for c in line.split("; ")[1].split()]
        p, hits = exact(rows, 1, 4, colors), int(line.split("Eval: ")[1].split()[0])
        assert abs(hits / 2048 - p) < 4 * (p * (1 - p) / 2048) ** 0.5
    with pytest.raises(ValueError):
        lines.colors_of_lines(graph_lines, asked, 4)
    with pytest.raises(ValueError):
        lines.colors_of_lines(graph_lines, asked, 1, "most")
