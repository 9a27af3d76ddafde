"""New documents as a stream: each micro-batch runs the batch pipeline once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.build import TreeBuilder
from quire.sources.pages import from_lines


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def build_trees(stream: DataFrame, nodes: str, failures: str, checkpoint: str, builder: TreeBuilder | None = None) -> StreamingQuery:
    """Trees of arriving documents, written per batch under its number, so a repeated batch overwrites itself.

    The stream's checkpoint is what resumes: documents handled once are not read again.
    """
    made = builder or TreeBuilder()

    def run(batch: DataFrame, number: int) -> None:
        done, failed = made.build(from_lines(batch.dropDuplicates(["doc_id"])))
        done.write.mode("overwrite").parquet(f"{nodes}/batch={number}")
        failed.write.mode("overwrite").parquet(f"{failures}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Documents per window of event time and source, rows later than ``late`` left out."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", width).alias("w"), by).agg(F.count(F.lit(1)).alias("documents"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "documents")


def write_windows(counts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Closed windows to a sink, each once."""
    return counts.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
