"""Operators on tables with nulls, empty, long and repeated texts, ties, and columns whose names they use inside."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogline.llm import media, mixing, sharding, signature_tree
from tests.llm.test_llm import components_of

LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ROWS = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, None, "a"), (3, "", None), (4, LONG, "b"), (5, LONG + " more", "b"), (None, "one two three four five six", "b"), (6, " \t", None)]
#: Columns that operators make for themselves.
NAMES = ["row", "of", "bucket", "at", "start", "range", "src", "class", "second", "block", "media", "size", "key", "slot", "shard", "name"]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


def empty(spark):
    return table(spark, [])


def test_slots_keep_columns_of_any_name(spark):
    df = table(spark).drop("shard").withColumn("shard", F.when(F.col("doc_id") < 5, F.col("doc_id") % 2).cast("int"))
    got = sharding.number_slots(df, ["doc_id", "source"])
    assert got.columns == [c for c in df.columns if c != "slot"] + ["slot"]
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r[n] == f"own {n}" for r in rows for n in NAMES if n not in ("slot", "shard"))
    for shard in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert sharding.number_slots(sharding.assign_shards(empty(spark), "doc_id", [(0, 1.0)]), ["doc_id"]).count() == 0


def test_linked_odd_tables(spark):
    got = sorted(map(repr, map(tuple, signature_tree.linked(table(spark)).collect())))
    ids = [r[0] for r in ROWS]
    # a null id counts for no minimum, so it joins the class of its text
    want = components_of([r[1] for r in ROWS], [10**9 if i is None else i for i in ids])
    assert got == sorted(repr((i, want[10**9 if i is None else i][0], want[10**9 if i is None else i][1] if i is not None else 1)) for i in ids)
    assert signature_tree.linked(empty(spark)).count() == 0


def test_sets_of_one_name_are_told_apart(spark, monkeypatch):
    """All sets get one first name; the second one tells them apart."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(30)) for _ in range(6)]
    texts += [texts[0], texts[1] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = signature_tree.class_id
    signed = spark.createDataFrame([(k, 26, 7, real(s)[1]) for k, s in enumerate(signature_tree.shingles(__import__("pyarrow").array(texts)))], "doc_id long, n_shingles long, class long, second long")
    names = [r["class"] for r in signature_tree.told_apart(signed).orderBy("doc_id").collect()]
    assert len(set(names)) == 7 and names[0] == names[6]
    plain = signature_tree.told_apart(signed.withColumn("class", F.col("doc_id")))
    assert plain.columns == ["doc_id", "n_shingles", "class"] and sorted(r["class"] for r in plain.collect()) == list(range(8))
    assert {r["doc_id"]: r["component_id"] for r in signature_tree.linked(docs).collect()} == {i: c for i, (_, c) in components_of(texts, list(range(8))).items()}


def test_media_of_odd_tables(spark):
    got = media.digests(media.encode(table(spark))).collect()
    assert len(got) == len(ROWS)
    for text in {r[1] for r in ROWS}:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        own = {(r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) for r in got if r["n_bytes"] == len(raw)}
        assert (len(raw), len(payload), hashlib.sha256(payload).hexdigest()) in own
    twice = [tuple(r) for r in got if r["doc_id"] == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert media.digests(media.encode(empty(spark))).count() == 0
    assert media.decode(spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, media binary")).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_mix_of_odd_tables(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "small", lambda df: df)
    got = mixing.mix(table(spark)).toPandas()
    assert len(got) == len(ROWS) and (got.taken[got["size"] == 0] == 0).all() and (got.taken <= 3 * got["size"]).all()
    total = got["size"].sum()
    assert abs(got.taken.sum() - total) <= max(2048, 0.05 * total)
    # repeated rows have one place and key, and the mix takes of the one what it doesn't of the other at most
    assert np.isfinite(got.target).all()
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.apply_mix(empty(spark)).columns == empty(spark).columns
