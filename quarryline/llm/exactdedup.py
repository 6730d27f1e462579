"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of new rows is reduced to one row per digest,
anti-joined to the index by sort-merge (the index side needs neither a shuffle nor a sort across buckets),
and what is new is appended. Batches that come in descending order of id leave the largest id of each text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, shared_path, written


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z in lower case; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """A growing table (digest, keep_id), bucketed and sorted by digest, one row per digest."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            self.path = shared_path(spark, "digest-index")
            self._write(spark.createDataFrame([], "digest binary, keep_id long"))

    def _write(self, rows: DataFrame) -> None:
        out = rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (out.option("path", self.path) if hasattr(self, "path") else out).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, members: DataFrame) -> DataFrame:
        """Appends the digests of members (doc_id, digest) that the index lacks, with their largest id. Returns them."""
        # Written, as Spark would otherwise move the join below the aggregate and shuffle a digest's every row.
        batch = written(members.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "batch-digests")
        fresh = written(batch.join(self.rows().hint("merge"), "digest", "left_anti"), "fresh-digests")
        self._write(fresh.repartition(self.buckets, "digest"))
        self.spark.catalog.refreshTable(self.name)
        return fresh

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Groups are texts that are identical after lower-casing A-Z; the row with the largest doc_id stays.
    docs enters the index as ``batches`` ranges of doc_id, largest first, each by anti-join and append.
    With an index that already holds rows, a text found there keeps the id found there, and no new row is kept.

    Null text counts as empty. Null ids are smaller than all others; a group of null ids only keeps one of them
    (keep_id null). Rows that repeat an id within a group stay apart: one of them is kept. An empty table gives
    no rows. Other columns of docs are not read, whatever their names.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark)
    members = written(digests(docs), "digests")
    low, high = members.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        index.add(members)
    else:
        step = max(1, -(-(high - low + 1) // batches))
        for b in reversed(range(batches)):
            inside = F.col("doc_id").between(low + b * step, low + (b + 1) * step - 1)
            index.add(members.where(inside if b else inside | F.col("doc_id").isNull()))
    sizes = members.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = written(sizes.join(index.rows(), "digest"), "digest-groups")
    if own:
        index.drop()
    # Equal rows meet before the join; the join's own exchanges let Spark split a digest that holds many ids.
    once = members.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    out = once.join(groups, "digest").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
