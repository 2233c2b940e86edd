"""Session settings, the shared scratch folder and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Largest number of rows that ``small`` lets Spark broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a bucket, where a table is too small to fill as many buckets as a shuffle has partitions.
BUCKET_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset (tests on one machine) a temporary folder is made and used as checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="fogline-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    The files cut the lineage and outlive any executor; the schema is passed on, so that empty tables work too.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(spark: SparkSession, rows: int) -> int:
    """As many buckets as ``rows`` fill, and at most as many as a shuffle has partitions: a small table isn't cut up with larger inputs."""
    return min(shuffle_partitions(spark), -(-max(1, rows) // BUCKET_ROWS))


class Rounds:
    """The state of a loop in the shared folder: the table of each round takes the place of the one before it."""

    def __init__(self, name: str):
        self.name, self.path, self.watched = name, None, 0

    def write(self, df: DataFrame, watch: Column | None = None) -> DataFrame:
        """Write the next state, then delete the last one, which nothing but ``df`` may read.

        ``watched`` then is how many rows meet ``watch``, counted as they are written.
        """
        path, schema, seen = scratch_path(df.sparkSession, self.name), df.schema, Observation()
        if watch is not None:
            df = df.observe(seen, F.count_if(watch).alias("n"))
        df.write.parquet(path)
        if watch is not None:
            self.watched = seen.get["n"]
        if self.path:
            drop_path(df.sparkSession, self.path)
        self.path = path
        return df.sparkSession.read.schema(schema).parquet(path)


class Buckets:
    """A table of the shared folder in buckets by key: joins by exactly the key columns, in their order, read it where it lies.

    ``write`` puts the next state, or the one table there is, in place of the last one, and ``watched`` then is how many of its rows meet
    ``watch``, counted as they are written. A state that is joined with its changes by key is so never shuffled itself.
    """

    def __init__(self, spark: SparkSession, name: str, by: Sequence[str], buckets: int | None = None):
        self.spark, self.name, self.by, self.watched = spark, name, list(by), 0
        self.buckets = buckets or shuffle_partitions(spark)
        self.table = self.path = self.rows = None

    def write(self, df: DataFrame, watch: Column | None = None) -> DataFrame:
        """The rows as they lie; nothing but ``df`` may read the state before."""
        table, path, seen = f"{self.name.replace('-', '_')}_{uuid.uuid4().hex}", scratch_path(self.spark, self.name), Observation()
        if watch is not None:
            df = df.observe(seen, F.count_if(watch).alias("n"))
        df.write.option("path", path).bucketBy(self.buckets, *self.by).saveAsTable(table)
        if watch is not None:
            self.watched = seen.get["n"]
        self.drop()
        self.table, self.path = table, path
        self.rows = self.spark.table(table)
        return self.rows

    def drop(self) -> None:
        if self.table:
            self.forget()
            drop_path(self.spark, self.path)

    def forget(self) -> None:
        """The catalog forgets the table; its files stay for whoever reads them."""
        self.spark.sql(f"drop table if exists {self.table}")


def ranked(df: DataFrame, order: str, rank: str) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of a column, as ``rank``; rows of equal values get places in any order.

    Rows are dealt out by ranges of that column and numbered within a range; a range starts where the one before it ends. The ranges
    are written first, so that they stay the same when a task runs again. Columns of any name are passed on; an empty table stays empty.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{order}`").alias("key"))
    ranges = materialize(rows.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "ranges")
    before = F.sum("count").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    starts = ranges.groupBy("range").count().select("range", F.coalesce(before, F.lit(0)).alias("start"))
    at = F.row_number().over(W.partitionBy("range").orderBy("key")) - 1
    placed = ranges.withColumn("at", at).join(F.broadcast(starts), "range")
    return placed.select("row.*", (F.col("start") + F.col("at")).cast("long").alias(rank))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with the hint that its join shuffles both sides, for tables that grow with the input: Spark sizes a table by the bytes of its
    files, also after an explode, and else may broadcast a side of many times as many bytes.
    """
    return df.hint("merge")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def partitions_of_shuffles(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, shuffles have ``n`` partitions: as many as the buckets of what they are joined with."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs send at most ``rows`` rows at once to Python workers: for long texts, to bound their memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
