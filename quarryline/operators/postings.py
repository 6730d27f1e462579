"""Postings kept for search: by term, so that a query reads only what its terms need.

A folder of postings is partitioned by a hash of the term into BUCKETS and sorted by term inside. A search first takes the
buckets of its terms, so other folders are never listed or read, then the terms themselves reach the Parquet reader, which
skips row groups by their smallest and largest term. How many documents hold a term is kept beside, as changes that add
up; so frequencies and their mean are known without reading postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

BUCKETS = 32
#: Up to so many asked terms are handed to the reader; beyond that it would skip little.
TERMS_PUSHED = 2000


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, dl, bucket, terms, tfs): for each row of docs and each bucket in which its text has terms, those terms, with a blank
    between them as a token has none, and how often each occurs. They are sorted and counted inside the row, so no postings are
    shuffled for it."""
    one = lambda c: F.explode(F.array(c))  # noqa: E731  # a generator: what it makes is made once, not at each use
    # Where runs of equal values end; get() is null behind the last.
    ends = lambda c, of: F.filter(F.sequence(F.lit(1), F.size(c)), lambda i: ~of(F.get(c, i - 1)).eqNullSafe(of(F.get(c, i))))
    before = lambda c, i: F.when(i == 0, 0).otherwise(F.get(c, i - 1))
    t = docs.select(*keys, one(tokens(F.col(text))).alias("t")).where(F.size("t") > 0)
    t = t.select(*keys, F.size("t").alias("dl"), one(F.array_sort(F.transform("t", lambda w: F.struct(bucket_of(w).alias("bucket"), w.alias("term"))))).alias("t"))
    t = t.select("*", one(ends(F.col("t"), lambda x: x)).alias("e"))
    term = lambda e, i: F.struct(F.get("t", e - 1)["bucket"].alias("bucket"), F.get("t", e - 1)["term"].alias("term"), (e - before(F.col("e"), i)).alias("tf"))
    t = t.select(*keys, "dl", one(F.transform("e", term)).alias("t"))
    t = t.select("*", one(ends(F.col("t"), lambda x: x["bucket"])).alias("e"))
    t = t.select(*keys, "dl", "t", "e", F.posexplode("e").alias("i", "end"))
    begin = before(F.col("e"), F.col("i"))
    t = t.select(*keys, "dl", F.get("t", begin)["bucket"].alias("bucket"), one(F.slice("t", begin + 1, F.col("end") - begin)).alias("t"))
    return t.select(*keys, "dl", "bucket", F.array_join("t.term", " ").alias("terms"), F.col("t.tf").alias("tfs"))


def each(rows: DataFrame) -> DataFrame:
    """The postings of :func:`counted` rows: terms and tfs become term and tf."""
    own = [c for c in rows.columns if c not in ("terms", "tfs")]
    return rows.select(*own, "tfs", F.posexplode(F.split("terms", " ")).alias("i", "term")).select(*own, "term", F.get("tfs", "i").cast("long").alias("tf"))


def write(rows: DataFrame, path: str, key: str) -> None:
    """:func:`counted` rows to a folder of postings. Ranges of (bucket, key) are dealt out, all terms that a row has in a bucket at
    once, so a very frequent term lies in many files. Rows with the same key and dl add up."""
    dealt = each(rows.repartitionByRange("bucket", key))
    others = [c for c in dealt.columns if c not in ("bucket", "term", key, "tf")]
    # Such rows stand beside each other in the order of the files, which is that of the window.
    same = Window.partitionBy("bucket", "term", key, *others).orderBy("tf")
    own = dealt.withColumn("_n", F.row_number().over(same)).withColumn("tf", F.sum("tf").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    own.where("_n = 1").drop("_n").sortWithinPartitions("bucket", "term", key).write.option("compression", "zstd").partitionBy("bucket").parquet(path)


def for_terms(spark: SparkSession, paths: list[str], terms: DataFrame, schema) -> DataFrame:
    """The postings in folders for terms (term), each read from the buckets of its terms only; schema: that of the postings."""
    asked = terms.select("term").distinct()
    buckets = [r[0] for r in asked.select(bucket_of(F.col("term")).alias("b")).distinct().orderBy("b").collect()]  # BUCKETS at most
    few = [r[0] for r in asked.limit(TERMS_PUSHED + 1).collect()]
    out = None
    for path in paths:
        part = spark.read.schema(f"{schema}, bucket int").parquet(path).where(F.col("bucket").isin(*buckets))
        part = part.where(F.col("term").isin(*few)) if len(few) <= TERMS_PUSHED else part.join(asked, "term", "left_semi")
        out = part.drop("bucket") if out is None else out.unionByName(part.drop("bucket"))
    return out


def term_counts(posted: DataFrame) -> DataFrame:
    """(term, df, tokens): documents that hold the term, and how often they do."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tokens"))
