"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master may go without, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
    return spark.sparkContext.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/granary/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results that still read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from there: it cuts the lineage, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
