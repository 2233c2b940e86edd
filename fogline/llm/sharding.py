"""Sharding by rendezvous hashing over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sub-buckets of a shard in which rows are numbered; the rows of one bucket meet in one task.
SLOT_BUCKETS = 1024


def rendezvous(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The shard with the highest weighted score for ``key``: -w / ln(u), u a hash of key and shard in (0, 1).

    A shard's score depends on that shard alone. A further shard hence takes rows only into itself, a removed one
    loses only its own rows, and shares follow the weights. Ties of scores go to the smaller shard id. A null key is
    one more key.
    """
    if not shards or any(w <= 0 for _, w in shards):
        raise ValueError("at least one shard is needed, and weights above 0")
    table = F.array(*[F.struct(F.lit(int(s)).alias("id"), F.lit(float(w)).alias("w")) for s, w in shards])

    def score(x: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, x["id"]), 12).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-x["w"] / F.log(u)).alias("score"), (-x["id"]).alias("minus"))

    return -F.array_max(F.transform(table, score))["minus"]


def assign_shards(df: DataFrame, key: str, shards: Sequence[tuple[int, float]], grown: Sequence[tuple[int, float]] | None = None) -> DataFrame:
    """``df`` with ``shard`` and, if ``grown`` names another set of shards, ``grown_shard``. No shuffle.

    Columns of ``df`` with these names are replaced. Repeated rows and equal keys go to the same shard; an empty table
    stays empty.
    """
    out = df.withColumn("shard", rendezvous(F.col(key), shards).cast("int"))
    return out.withColumn("grown_shard", rendezvous(F.col(key), grown).cast("int") if grown else F.lit(None).cast("int"))


def number_slots(df: DataFrame, order: Sequence[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """``df`` (with ``shard``) and ``slot``: gapless numbers from 0 in each shard.

    Rows are numbered within hash buckets of a shard, and each bucket starts where the one before it ends, so a shard's
    rows never meet in one task. ``order`` names narrow columns that tell rows apart; rows equal in all of them are
    interchangeable. Other columns may have any names; a column ``slot`` is replaced. A null shard is numbered like any other; an
    empty table stays empty.
    """
    kept = [c for c in df.columns if c != "slot"]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("shard").alias("of"), *[F.col(f"`{c}`").alias(f"by{k}") for k, c in enumerate(order)])
    by = [f"by{k}" for k in range(len(order))]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    before = W.partitionBy("of").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("of", "bucket").count().select(F.col("of").alias("shard_"), F.col("bucket").alias("bucket_"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    at = rows.withColumn("at", F.row_number().over(W.partitionBy("of", "bucket").orderBy(*by)) - 1)
    placed = at.join(starts, F.col("of").eqNullSafe(F.col("shard_")) & (F.col("bucket") == F.col("bucket_")))
    return placed.select("row.*", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write a table with ``shard`` as one folder a shard; a shard's rows may come from many tasks and so fill many files."""
    df.write.partitionBy("shard").parquet(path)
