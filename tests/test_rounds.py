"""Loops that save work against plain ones: lazy seeds, covers by rounds."""

import random

from fogline.operators import influence, select
from tests.test_graph import EDGES


def made_edges(rng, nodes, n):
    rows = {(rng.randrange(nodes), rng.randrange(nodes), rng.randrange(1, 5)): rng.randrange(5, 40) for _ in range(n)}
    return [(a, b, c, p) for (a, b, c), p in sorted(rows.items()) if a != b]


def test_lazy_seeds_equal_plain_greedy(spark):
    rng = random.Random(6)
    df = spark.createDataFrame(made_edges(rng, 60, 160), EDGES)
    masks = influence.target_masks(df, spark.createDataFrame([(k,) for k in range(0, 60, 3)], "node long"), 100).persist()
    rows = [(r["target"], r["chunk"], r["node"], r["mask"] & (1 << 64) - 1) for r in masks.collect()]
    covered, want, total = {}, [], 0
    for rank in range(1, 21):
        gain = {}
        for t, c, node, m in rows:
            gain[node] = gain.get(node, 0) + bin(m & ~covered.get((t, c), 0)).count("1")
        best = min(gain, key=lambda x: (-gain[x], x))
        if not gain[best]:
            break
        total += gain[best]
        want.append((rank, best, total))
        for t, c, node, m in rows:
            if node == best:
                covered[t, c] = covered.get((t, c), 0) | m
    got = influence.seeds(masks, 20, batch=4).orderBy("rank").collect()
    assert [tuple(r)[:3] for r in got] == want and len(want) > 5
    # the first round counts all nodes, later ones some
    assert got[0]["recounted"] == len({r[2] for r in rows}) and sum(r["recounted"] for r in got[1:]) < 0.7 * got[0]["recounted"] * len(got[1:])
    assert influence.seeds(masks.limit(0), 3).count() == 0


def brute_cover(paths, k):
    """paths: (rank, pair, colors)."""
    left = sorted(paths)
    every, chosen, done = {p for _, p, _ in left}, set(), set()
    while done != every:
        rest = [x for x in left if x[1] not in done]
        _, pair, needs = min(rest, key=lambda x: (len(set(x[2]) - chosen), x[0], x[1]))
        chosen |= set(needs)
        while len(chosen) > k:
            spare = [c for c in sorted(chosen - set(needs)) if all(any(set(cs) <= chosen - {c} for _, p, cs in left if p == d) for d in done)]
            if not spare:
                return []
            chosen.discard(spare[0])
        done.add(pair)
    return sorted(chosen)


def test_covers_equal_brute_force(spark):
    rng = random.Random(9)
    queries = {q: [(rank, pair, sorted(rng.sample(range(1, 9), rng.randint(1, 4)))) for pair in range(rng.randint(1, 5)) for rank in range(1, rng.randint(2, 5))] for q in range(12)}
    routes = spark.createDataFrame([(q, pair, rank, colors) for q, ps in queries.items() for rank, pair, colors in ps], "query_id long, pair long, rank int, colors array<long>")
    for k in (3,):
        got = {}
        for r in select.minimum_cover(routes, k).collect():
            got.setdefault(r["query_id"], []).append(r["color"])
        want = {q: brute_cover(ps, k) for q, ps in queries.items()}
        assert {q: sorted(c) for q, c in got.items()} == {q: c for q, c in want.items() if c}
        assert any(want.values()) and not all(want.values())
    assert select.minimum_cover(routes.limit(0), 3).count() == 0
