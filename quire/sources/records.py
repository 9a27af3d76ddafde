"""Training pairs, error records and examples: readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.schemas import ERROR_RECORD, EXAMPLE, TRAINING_PAIR


def read_training(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Training pairs, one JSON file each or one object a line; ``tree`` stays JSON text."""
    return spark.read.option("multiLine", not lines).schema(TRAINING_PAIR).json(folder)


def read_errors(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(ERROR_RECORD).json(folder)


def read_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Examples, one JSON object a line; blank lines are skipped."""
    return spark.read.schema(EXAMPLE).json(folder).where("messages is not null")


def pending(documents: DataFrame, done: DataFrame, failed: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Documents neither done nor failed; with ``limit`` the first ones by key."""
    rest = documents.join(done.select(key).union(failed.select(key)).distinct(), key, "left_anti")
    return rest if limit is None else rest.orderBy(key).limit(limit)


def known(spark: SparkSession, folder: str) -> DataFrame:
    """The papers that a folder of JSON lines holds; none where it does not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "arxiv_id string")
    return spark.read.schema("arxiv_id string").json(folder).select("arxiv_id").where("arxiv_id is not null").distinct()


def pair_json(results: DataFrame) -> DataFrame:
    """``(value)``: training pairs as JSON lines, ``tree`` (JSON text) standing as an object."""
    head = F.to_json(F.struct("arxiv_id", "document_text", "page_count", "total_tokens"))
    tail = F.concat(F.lit(',"tree":'), F.coalesce("tree", F.lit("null")), F.lit(',"metadata":'), F.to_json("metadata"), F.lit("}"))
    return results.select(F.concat(F.left(head, F.length(head) - 1), tail).alias("value"))


def write_results(results: DataFrame, training: str, errors: str) -> None:
    """``(arxiv_id, ..., error, elapsed_seconds)``: successes and failures into two folders of JSON lines.

    Papers that the folder holds already are skipped, so a job that runs again writes nothing twice.
    """
    spark = results.sparkSession
    good = results.where("error is null").drop("error", "elapsed_seconds").join(known(spark, training), "arxiv_id", "left_anti")
    bad = results.where("error is not null").select("arxiv_id", "error", "elapsed_seconds", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    if {"tree", "metadata"} <= set(good.columns):
        pair_json(good).write.mode("append").text(training)
    else:
        good.write.mode("append").json(training)
    bad.join(known(spark, errors), "arxiv_id", "left_anti").write.mode("append").json(errors)


def progress(results: DataFrame, skipped: int = 0) -> DataFrame:
    """``(processed, errors, skipped, total)``."""
    counts = results.agg(F.count(F.when(F.col("error").isNull(), 1)).alias("processed"), F.count("error").alias("errors"))
    return counts.withColumn("skipped", F.lit(skipped).cast("long")).withColumn("total", F.col("processed") + F.col("errors") + skipped)


def save_progress(results: DataFrame, path: str, skipped: int = 0) -> None:
    """The counters of ``progress`` and the time, as one JSON line in a folder."""
    stamped = progress(results, skipped).withColumn("updated", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    stamped.coalesce(1).write.mode("overwrite").json(path)
