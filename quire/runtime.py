"""Session, table and lineage helpers shared by every part of the engine."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "training training_nodes batch_runs error_records paper_authors benchmark labels"
).split()


def session(app: str = "quire", cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; nothing is cached or collected."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir_is_set(spark: SparkSession) -> bool:
    return spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the reliable checkpoint folder, its lineage cut.

    The folder is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as in tests
    on one machine, a temporary folder is made and removed again at exit.
    """
    spark = df.sparkSession
    if not _checkpoint_dir_is_set(spark):
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            given = tempfile.mkdtemp(prefix="quire-checkpoint-")
            atexit.register(shutil.rmtree, given, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(given)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if not getattr(context, "_quire_shipped", False):
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="quire-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = os.path.join(folder, "quire_src.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        context.addPyFile(target)
        context._quire_shipped = True
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions, as from one small file, before work in Python.

    Inputs of at least one partition a core, as any large one has, are left as they are: no shuffle.
    So are inputs that are shuffled anyway, whose partitions are known only by running them.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
