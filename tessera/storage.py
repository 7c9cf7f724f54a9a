"""Tables written once to the shared folder, to fix a result or to cut a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_checkpoint_dir


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has written; frames read from it can't be used afterwards."""
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(scratch_root(spark))
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_dir(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    What follows survives lost executors without recomputing it, sees the same
    rows each time, and the planner knows its size, so it is broadcast only when
    that is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
