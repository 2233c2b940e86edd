"""Walks of few edges: as by brute force, and not followed where no target is near."""

import random

import pytest

from fogline.operators import paths


class Watched(paths.Rounds):
    most = 0

    def write(self, df, watch=None):
        out = super().write(df, watch)
        Watched.most = max(Watched.most, out.count())
        return out


def test_walks_of_few_edges_go_where_a_target_is_near(spark, monkeypatch):
    monkeypatch.setattr(paths, "Rounds", Watched)
    Watched.most = 0
    # 0 to 15 hubs, each of them to 15 leaves, each of them to 15 others; 99 is next to one hub, and behind one leaf
    arcs = [(0, h) for h in range(1, 16)] + [(h, 100 * h + i) for h in range(1, 16) for i in range(15)] + [(100 * h + i, 10_000 + i) for h in range(1, 16) for i in range(15)]
    arcs += [(4, 99), (705, 99), (10_003, 99)]
    edges = spark.createDataFrame([(a, b, 1, 50, i) for i, (a, b) in enumerate(arcs)], "src long, dst long, color long, p_pct long, edge_id long")
    asked = spark.createDataFrame([(1, [0], [99])], "query_id long, sources array<long>, targets array<long>")
    found = paths.top_walks(edges, asked, 10, 3).orderBy("rank").collect()
    assert [r["path"].count("|") + 1 for r in found] == [2, 3]
    assert Watched.most <= 15  # 225 walks of two edges, 225 of three


@pytest.mark.parametrize("hops", [1, 3, 4])
def test_walks_of_few_edges_are_those_of_brute_force(spark, hops):
    rng = random.Random(hops)
    arcs = [(i, rng.randrange(9), rng.randrange(9), rng.randrange(20, 90)) for i in range(26)]
    arcs = [x for x in arcs if x[1] != x[2]]
    edges = spark.createDataFrame([(a, b, 1, p, i) for i, a, b, p in arcs], "src long, dst long, color long, p_pct long, edge_id long")
    asked = [(1, [0, 1], [7, 8]), (2, [3], [4]), (3, [5], [5, 6])]
    cost = {r["edge_id"]: r["cost"] for r in paths.with_cost(edges).collect()}
    want = []
    for q, sources, targets in asked:
        done, open_ = [], [(s, None, 0, []) for s in sources if s not in targets]
        for _ in range(hops):
            open_ = [(b, node, c + cost[i], [*ids, i]) for node, prev, c, ids in open_ for i, a, b, _ in arcs if a == node and b != prev]
            done += [(c, ids) for node, _, c, ids in open_ if node in targets]
            open_ = [x for x in open_ if x[0] not in targets]
        want += [(q, rank, c, ids) for rank, (c, ids) in enumerate(sorted(done)[:5], 1)]
    got = paths.top_walks(edges, spark.createDataFrame(asked, "query_id long, sources array<long>, targets array<long>"), 5, hops)
    assert sorted((r["query_id"], r["rank"], r["cost"], r["edges"]) for r in got.collect()) == sorted(want)
