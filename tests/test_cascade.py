"""Targets that one cascade reaches, against reverse reach from each of them."""

import random

from pyspark.sql import functions as F

from fogline.operators import influence
from fogline.operators.reach import edge_masks, reach, start

WORLDS = 100  # two masks, the second one not full


def _graph(spark, seed):
    """A dense part, two lesser ones of which one leads in and one is led to, and a loop by itself."""
    rng = random.Random(seed)
    arcs = [(rng.randrange(20), rng.randrange(20)) for _ in range(90)]
    arcs += [(rng.randrange(20, 28), rng.randrange(28)) for _ in range(14)] + [(rng.randrange(20), rng.randrange(28, 36)) for _ in range(6)]
    arcs += [(rng.randrange(28, 36), rng.randrange(28, 36)) for _ in range(12)] + [(40, 41), (41, 40), (41, 42)]
    rows = [(a, b, 1 + i % 3, rng.choice([5, 30, 60, 100]), i) for i, (a, b) in enumerate(arcs) if a != b]
    return spark.createDataFrame(rows, "src long, dst long, color long, p_pct long, edge_id long")


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_cascade_hits_are_those_of_reverse_reach(spark):
    edges = _graph(spark, 7)
    targets = spark.createDataFrame([(t,) for t in (2, 7, 22, 29, 33, 40, 42, 99)], "node long")
    sources = edges.select(F.col("src").alias("node")).distinct().join(targets, "node", "left_anti")
    back = reach(edge_masks(edges, WORLDS), start(targets.select(F.col("node").alias("target"), "node"), WORLDS), ["target"], reverse=True)
    met = back.join(sources, "node", "left_semi").groupBy("target", "chunk").agg(F.bit_or("mask").alias("m")).groupBy("target").agg(F.sum(F.bit_count("m")).alias("hits"))
    assert _rows(influence.cascade_hits(edges, sources, targets, WORLDS), "node", "hits") == _rows(met, "target", "hits")


def test_no_edge_into_a_source_is_tossed(spark, monkeypatch):
    tossed = []
    monkeypatch.setattr(influence, "edge_masks", lambda edges, worlds: tossed.append(edges) or edge_masks(edges, worlds))
    influence.cascade_hits(_graph(spark, 7), spark.range(30).select(F.col("id").alias("node")), spark.createDataFrame([(31,)], "node long"), WORLDS)
    assert tossed[0].where("dst < 30").count() == 0 and tossed[0].where("dst >= 30").count() > 0
