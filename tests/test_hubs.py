"""Reach by way of hubs against plain reach from each start."""

import random

import pytest
from pyspark.sql import functions as F
from test_cascade import WORLDS, _graph, _rows

from fogline.operators import hubs
from fogline.operators.reach import edge_masks, reach, start


@pytest.mark.parametrize("tried", [0, 1, 4])
def test_reach_by_hubs_is_plain_reach(spark, tried):
    edges = _graph(spark, tried)
    masks = edge_masks(edges, WORLDS)
    # two starts of one query lie in different parts; 99 has no edges
    begin = spark.createDataFrame([(q, q) for q in (0, 3, 21, 25, 30, 40, 99)] + [(200, 5), (200, 24), (200, 41)], "query_id long, node long")
    plain = reach(masks, start(begin, WORLDS), ["query_id"])
    shared = hubs.shared_reach(masks, begin, ["query_id"], WORLDS, tried)
    hits = plain.groupBy("query_id", "node").agg(F.sum(F.bit_count("mask")).alias("hits"))
    assert _rows(hubs.pair_hits(shared, ["query_id"], WORLDS), "query_id", "node", "hits") == _rows(hits, "query_id", "node", "hits")
    total = hits.groupBy("query_id").agg(F.sum("hits").alias("hits"))
    assert _rows(hubs.spread_of_starts(shared, ["query_id"]), "query_id", "hits") == _rows(total, "query_id", "hits")


def test_what_lies_ahead_of_a_hub_is_not_found_again_from_each_start(spark):
    rng = random.Random(5)
    rows = [(a, b, 1, 20, i) for i, (a, b) in enumerate((rng.randrange(60), rng.randrange(60)) for _ in range(1500)) if a != b]
    masks = edge_masks(spark.createDataFrame(rows, "src long, dst long, color long, p_pct long, edge_id long"), WORLDS)
    begin = spark.createDataFrame([(q, q) for q in range(60)], "query_id long, node long")
    rest = hubs.shared_reach(masks, begin, ["query_id"], WORLDS).rest
    assert rest.agg(F.sum(F.bit_count("mask"))).first()[0] < 0.05 * 60 * 60 * WORLDS
