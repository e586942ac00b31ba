"""Session helpers: defaults for local use, and cutting lineage in a way that survives lost executors."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "recordlake") -> SparkSession:
    """A local session for tests and the bench.  On a cluster the caller brings its own."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
             .config("spark.sql.adaptive.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads it back.

    The plan restarts from files every executor can read again, with real sizes for join planning and
    column pruning for the steps that need only a part of it.
    """
    path = shared_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach, under the checkpoint folder the cluster names."""
    import uuid
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="recordlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """For a local session only: one small file is one piece, so its rows are dealt out to all cores.

    On a cluster tables stay as they are read; how finely is set by ``spark.sql.files.maxPartitionBytes``.
    """
    context = df.sparkSession.sparkContext
    local = context.master.startswith("local[")
    return df.repartition(context.defaultParallelism) if local and len(df.inputFiles()) < context.defaultParallelism else df
