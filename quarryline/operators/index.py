"""Change detection and maintenance of a content-hashed index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_changes(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): new, modified or deleted, by a full outer join of (path, hash)."""
    m, c = manifest.select("path", F.col("hash").alias("old")), current.select("path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return m.join(c, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def is_stale(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """One row: whether an indexed path is gone or differs; new paths don't count."""
    gone = detect_changes(manifest, current).where("change <> 'new'")
    return gone.agg((F.count(F.lit(1)) > 0).alias("stale"))


def merge(index: DataFrame, fresh: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """index without the keys of fresh and removed, and fresh."""
    drop = fresh.select(key).union(removed.select(key)).distinct()
    return index.join(drop, key, "left_anti").unionByName(fresh)
