"""Shared plumbing: inputs, the shared folder, written tables, id hashes."""

from __future__ import annotations

import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Used only where a session names no shared folder (tests on one machine).
LOCAL_SHARED_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the folder that driver and executors share. ValueError on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or LOCAL_SHARED_DIR
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read back.

    The files outlive executors, so a lost executor costs the tasks in flight only.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Arrow batches bounded by rows and bytes, so that very long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def id_crc32(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def task_name() -> str:
    """A file stem that no other attempt of any task uses."""
    ctx = TaskContext.get()
    part, attempt = (ctx.partitionId(), ctx.taskAttemptId()) if ctx else (0, 0)
    return f"part-{part:05d}-{attempt}-{uuid.uuid4().hex[:8]}"


def file_system(path: str):
    """(file system, path on it) of a shared path: file:, hdfs: and the like through pyarrow."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def keeping(docs: DataFrame, needed: tuple[str, ...], stage) -> DataFrame:
    """stage(docs, columns) with every column that it doesn't need under a name that can't clash with its own."""
    inner = [c if c in needed else f"__own{i}" for i, c in enumerate(docs.columns)]
    out = stage(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner, strict=True)]), inner)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, inner, strict=True)])
