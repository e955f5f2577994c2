"""Intermediate tables in the shared checkpoint folder.

A result that several branches read is written once instead of being computed per branch. The
folder survives the loss of executors, and the written table brings its size, so that Spark can
choose joins by it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``.

    Where it is unset, the context's own checkpoint folder, and only on a local master a new
    temporary one.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def run_folder(spark: SparkSession) -> str:
    """Where this application stages its tables."""
    return f"{shared_folder(spark).rstrip('/')}/run-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the run's folder and read back.

    The table stays for as long as results may read it; ``clear_staged`` drops all of a run.
    """
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete what this application has staged. Only for callers that have written their results."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
