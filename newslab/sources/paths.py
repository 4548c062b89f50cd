"""File checks through the Hadoop file system of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str):
    """The file system of a path, and the path as that names it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = located(spark, path)
    return fs.exists(hadoop_path)


def require(spark: SparkSession, path: str, what: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")
