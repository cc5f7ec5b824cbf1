"""Reading of named parquet tables below one directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` (a file or a directory) below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The parquet at ``path``; if there is none, what ``make`` gives is written there first.

    Only a missing path is made anew; an unreadable one raises.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def years_of(spark: SparkSession, root: str) -> DataFrame:
    """All parquet files of a directory with one folder per year, found by glob; with folders named year=YYYY Spark prunes them by itself."""
    return spark.read.option("recursiveFileLookup", "false").parquet(f"{root}/*/*.parquet")
