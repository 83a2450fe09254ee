"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where driver and executors are one process is there a temporary folder instead of the setting; elsewhere a
    machine-local folder would be lost with its executor, so that is an error.
    """
    configured = spark.conf.get(_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError(f"set {_CONF} to a folder all executors share")
    made = tempfile.mkdtemp(prefix="fleetward-")
    spark.conf.set(_CONF, made)
    return made


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fleetward/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage is cut, columns stay prunable.

    Used where several branches read the result of one expensive scan.  Losing
    executors afterwards costs nothing, because the table is in shared storage.
    """
    return _written(df, staging_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(rows: DataFrame) -> DataFrame:
    """The side of a join that is never broadcast: a stored table is small by the size of its files, not by its rows."""
    return rows.hint("merge")


class Run:
    """Tables of one run in a folder of their own, dropped together when its results are written."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = staging_path(spark, name)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.path}/{name}")

    def drop(self) -> None:
        """Remove the folder through the file system that it is in."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
