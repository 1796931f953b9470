"""The cluster's shared folder: lineage that is cut into it, and files that jobs leave for each other."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where none is set and all runs on one machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="loomset-")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(folder: str) -> str:
    """The path by which workers open files of a folder that all of them mount."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"{folder} is not mounted on workers; read it through Spark (binaryFile)")
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
