"""Masks side by side: coins, reach and the work of hubs."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_cascade import WORLDS, _graph, _rows

from fogline.functions import many_coins
from fogline.operators import hubs
from fogline.operators.reach import edge_masks, reach, start
from fogline.operators.wide import lay_wide, narrow, names, wide_masks, wide_reach, widened


def _plain(key, p, worlds):
    mask, at, i = [0] * ((worlds - 1) // 64 + 1), -1, 0
    while p > 0:
        i += 1
        u = (int(hashlib.md5(f"{i}:{key}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0
        at += 1 + (0 if p >= 1 else min(math.floor(math.log(u) / math.log1p(-p)), worlds))
        if at >= worlds:
            break
        mask[at // 64] |= 1 << (at % 64)
    return mask


def test_coins_of_a_batch_are_those_of_each_edge():
    keys = ["", "é" * 20, *("k" * n for n in (50, 51, 52, 53, 54, 55, 56, 62, 63, 64, 65, 200)), *(f"{i}>{7 * i}#{i % 5}@{i * i}" for i in range(300))]
    chances = [0.9, 0.3, 1, 0, -1, 2, 1e-9, 0.999, 0.01, 0.05, 0.1]
    p = np.array([chances[i % len(chances)] for i in range(len(keys))])
    for worlds in (1, 64, 65, 1000):
        want = [_plain(k, q, worlds) for k, q in zip(keys, p, strict=True)]
        assert many_coins.masks(pa.array(keys), p, worlds).tolist() == want
        assert many_coins.masks(pa.array(keys)[40:90], p[40:90], worlds).tolist() == want[40:90]
    assert many_coins.masks(pa.array([], pa.string()), np.array([]), 70).shape == (0, 2)


def test_wide_masks_and_reach_are_those_of_narrow_ones(spark):
    edges = _graph(spark, 3).union(spark.createDataFrame([(50, 51, 1, 0, 900), (50, 52, 1, None, 901), (50, 53, 1, 100, 902)], "src long, dst long, color long, p_pct long, edge_id long"))
    masks, wide = edge_masks(edges, WORLDS), wide_masks(edges, WORLDS)
    met = narrow(wide, names(WORLDS), "em").groupBy("src", "dst", "chunk").agg(F.bit_or("em").alias("em"))
    assert _rows(met, "src", "dst", "chunk", "em") == _rows(masks.groupBy("src", "dst", "chunk").agg(F.bit_or("em").alias("em")), "src", "dst", "chunk", "em")
    begin = start(spark.createDataFrame([(3,), (22,), (50,)], "node long"), WORLDS)
    laid = lay_wide(wide.withColumnsRenamed({"src": "node", "dst": "next"}), 3)
    found = narrow(wide_reach(laid, widened(begin, ["node"], WORLDS, "mask"), WORLDS), names(WORLDS))
    assert _rows(found, "chunk", "node", "mask") == _rows(reach(masks, begin, []), "chunk", "node", "mask")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_hubs_of_all_worlds_are_searched_once_each_way_over_a_row_an_edge(spark, monkeypatch):
    monkeypatch.setattr(hubs, "BLOCK_STARTS", 2)
    searched, edges = [], _graph(spark, 4)
    monkeypatch.setattr(hubs, "wide_reach", lambda laid, begin, worlds: searched.append(laid.rows.count()) or wide_reach(laid, begin, worlds))
    begin = spark.createDataFrame([(q, q) for q in (0, 3, 25)], "query_id long, node long")
    shared = hubs.shared_reach(wide_masks(edges, WORLDS), begin, ["query_id"], WORLDS)
    assert searched == [wide_masks(edges, WORLDS).count()] * 2 and searched[0] <= edges.count()
    plain = reach(edge_masks(edges, WORLDS), start(begin, WORLDS), ["query_id"]).groupBy("query_id", "node").agg(F.sum(F.bit_count("mask")).alias("hits"))
    assert _rows(hubs.pair_hits(shared, ["query_id"], WORLDS), "query_id", "node", "hits") == _rows(plain, "query_id", "node", "hits")
