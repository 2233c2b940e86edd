"""Filters of a fixed size: which rows of a table may have a key out of a set, without a shuffle of the table.

A filter has a bit for each hash value modulo its size. It is one binary value, so what is sent to the executors has a proven bound,
whatever the input. Where more keys are set than fit, more rows pass the filter; callers check those exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.functions.runtime import materialize

#: Bits of a filter: 2 MB. A multiple of BUCKET, the bits of one bitmap aggregate.
BITS, BUCKET = 1 << 24, 1 << 15


def filter_of(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """One row with the filter of ``key``, a BIGINT, in the column ``bits``. An empty table gives a filter without any bit."""
    at = F.pmod(key, F.lit(bits).cast("long")) + 1  # bitmap positions count from 1
    found = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("part"))
    none = F.repeat(F.lit("00"), F.lit(BUCKET // 8))
    every = keys.sparkSession.range(1, bits // BUCKET + 1, numPartitions=1).withColumnRenamed("id", "bucket").join(found, "bucket", "left")
    parts = F.array_sort(F.collect_list(F.struct("bucket", F.coalesce(F.hex("part"), none).alias("part"))))
    return materialize(every.agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["part"]), "")).alias("bits")), "filter")


def may_have(told: DataFrame, key: Column, bits: int = BITS) -> Column:
    """Whether the filter ``told`` has the bit of ``key``. A null key has none."""
    at = F.pmod(key, F.lit(bits).cast("long"))
    byte = F.conv(F.hex(F.substring(told.scalar(), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``gone`` (id), with all columns. Null ids stay.

    Only rows that the filter of ``gone`` lets through are shuffled, for an anti join by id; ids stand for all rows that have them.
    """
    key = F.col(doc_id).cast("long")
    told = filter_of(gone, F.xxhash64("id"))
    maybe = F.col("id").isNotNull() & may_have(told, F.xxhash64("id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("id"))
    left = rows.where(maybe).join(gone, "id", "left_anti")
    return rows.where(~maybe).select("row.*").unionByName(left.select("row.*"))
