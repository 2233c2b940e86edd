"""A small graph isn't cut into as many pieces as a shuffle of large inputs has partitions."""

import pytest

from fogline.functions import coins, runtime
from fogline.operators.reach import edge_masks, reach, start


@pytest.fixture
def many_partitions(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "60")
    yield
    spark.conf.set(key, before)


def _edges(spark, n):
    return spark.createDataFrame([(i, i + 1, 1, 100) for i in range(n)], "src long, dst long, color long, p_pct long")


def test_reach_lays_a_small_graph_in_few_buckets(spark, monkeypatch, many_partitions):
    laid, write = [], runtime.Buckets.write
    monkeypatch.setattr(runtime.Buckets, "write", lambda self, *a: laid.append(self.buckets) or write(self, *a))
    begin = start(spark.createDataFrame([(0, 0)], "query_id long, node long"), 100)
    got = reach(edge_masks(_edges(spark, 3), 100), begin, ["query_id"]).select("node", "chunk").collect()
    assert sorted(map(tuple, got)) == [(n, c) for n in range(4) for c in range(2)]
    assert set(laid) == {1}


def test_few_edges_are_tossed_by_few_tasks(spark, many_partitions):
    edges, key = _edges(spark, 300), coins.edge_key(["src", "dst", "color"])
    for worlds, tasks in ((100, 1), (10_000, 15), (1_000_000, 60)):
        told = coins.existing(edges, worlds, ["src"], key, coins.F.lit(0.5))
        assert told.rdd.getNumPartitions() == tasks


def test_large_tables_fill_all_partitions(spark, many_partitions):
    assert [runtime.buckets_for(spark, n) for n in (0, 20_000, 20_001, 10**9)] == [1, 1, 2, 60]
