"""Query lines that arrive as files are evaluated as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fogline.operators import objectives
from fogline.sources import graph_text


def evaluate_lines(spark: SparkSession, edges: DataFrame, folder: str, out: str, checkpoint: str, objective: str = "sum", worlds: int = 64) -> StreamingQuery:
    """Start a stream over text files of `S;T; colors` lines: each batch is evaluated in one dataflow and appended to ``out``.

    A batch overwrites its own folder of ``out``, so a batch that runs again after a failure gives no row twice. Lines are
    keyed by a hash of their text; equal lines of a batch are evaluated once.
    """

    def each(batch: DataFrame, number: int) -> None:
        lines = graph_text.results(batch.select("value").distinct()).withColumn("query_id", F.xxhash64("sources", "targets", "colors"))
        chosen = lines.select("query_id", F.explode("colors").alias("color"))
        hits = objectives.evaluate(edges, lines.select("query_id", "sources", "targets"), chosen, objective, worlds)
        lines.join(hits, "query_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.text(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
