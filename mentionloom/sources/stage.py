"""Stages whose result is kept: computed once, read afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished result is at the path, in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], generate: bool = False) -> DataFrame:
    """The table at ``path``. ``generate`` makes it anew; otherwise it has to be there."""
    if generate:
        make().write.mode("overwrite").parquet(path)
    elif not exists(spark, path):
        raise FileNotFoundError(f"{path} has no finished result; generate it first")
    return spark.read.parquet(path)
