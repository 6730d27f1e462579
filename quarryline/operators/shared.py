"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in ``spark.checkpoint.dir``, or, on a local master that names none, in /tmp; ValueError on a cluster that names
    none, as its machines share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet at a :func:`shared_path`, read back: its work is done once, and outlives executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
