"""Intermediate tables in the shared folder of the cluster.

``settle`` writes a frame as parquet below ``spark.checkpoint.dir`` and reads it back, so that the result of a round or of a costly
kernel is computed once, its lineage ends there, and it outlives lost executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  A local session without one gets a temporary folder, a cluster without one raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidewright-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back; runs a job.  The files belong to the application's folder and may go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewright/{spark.conf.get('spark.app.id', 'app')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
