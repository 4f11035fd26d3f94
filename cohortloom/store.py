"""Reading tables and cutting lineage through a folder that every executor shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet files or Parquet directories."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that setting is absent (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="cohortloom-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return _own[key]


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation of it.

    Written as Parquet rather than by ``checkpoint()``: it is columnar and compressed, later reads still prune
    columns, and the files outlive any executor. They are deleted when the application ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"cohortloom-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
