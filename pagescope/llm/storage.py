"""Intermediate tables in the folder that driver and executors share.

A table written there cuts the lineage as a checkpoint does, stays columnar and
compressed, and survives the loss of any executor.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a new one, and only if this machine runs all tasks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext.getCheckpointDir()
        if not set_dir:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            set_dir = "file://" + tempfile.mkdtemp(prefix="pagescope-")
            spark.sparkContext.setCheckpointDir(set_dir)
        found = set_dir
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession):
    """Tables that are materialised within it without a path of their own go when it ends, and so do their shuffles."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            drop_path(spark, path)
        release_shuffles(spark)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it again."""
    spark = df.sparkSession
    if path is None:
        path = new_path(spark, name)
        if _SCOPES:
            _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table of this run that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs: its cleaner acts when the driver collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema with more fields."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def open_folder(uri: str):
    """(file system, path) of a folder that any worker can reach."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    system.create_dir(path, recursive=True)
    return system, path


def put_file(system, path: str, parts) -> int:
    """Writes the parts as one file that appears whole or not at all, whichever attempt of a task comes last."""
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with system.open_output_stream(own, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(own, path)
    return size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
