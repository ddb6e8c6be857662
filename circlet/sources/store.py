"""Where tables of our own are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir; in a folder of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="circlet-"))
    return f"{base.rstrip('/')}/circlet/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark reads."""
    store, at = _at(spark, path)
    store.delete(at, True)


def usage(spark: SparkSession, path: str) -> dict[str, int]:
    store, at = _at(spark, path)
    found = store.getContentSummary(at)
    return {"bytes": found.getLength(), "files": found.getFileCount()}
