"""Okapi BM25 over token lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_tokens, tokens
from .shared import written

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl). Map-side partial counts; a document's length rides along."""
    t = docs.select(key, tokens(F.col(text)).alias("t"))
    return t.select(key, F.explode("t").alias("term"), F.size("t").alias("dl")).groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.size(tokens(F.col(text))).alias("dl"))


def corpus(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """One row: n, avgdl. Documents without tokens count; texts aren't read again, as a posting's tf are its tokens."""
    total = posted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
    return docs.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("n", (F.col("tokens") / F.nullif("n", F.lit(0))).alias("avgdl"))  # one row each


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def idf(posted: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf): negative values become EPSILON times the mean over all terms, taken before."""
    return idf_of(posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")), totals)


def idf_of(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """As idf, from the number of documents of each term (term, df)."""
    raw = counts.select("term", "df").join(F.broadcast(totals.select("n"))).withColumn("raw", raw_idf(F.col("n"), F.col("df")))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """(query, term, qf): repeated query terms count as often as they occur."""
    return queries.select(F.col(query_key).alias("query"), F.explode(query_tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qf"))


def scored(posted: DataFrame, totals: DataFrame, weights: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(query, key, score) over 0 from stored postings (key, term, tf, dl), totals (n, avgdl), weights (term, idf) and the
    queries' terms. Postings of other terms are dropped before they are weighed. The postings are dealt out by key, once: what a term
    gives to each of the queries that ask for it is made and added up there."""
    asked = written(terms.join(weights.select("term", "idf"), "term"), "asked-terms")  # its size is known, so a small one is broadcast
    part = posted.repartition(key).join(asked, "term").join(F.broadcast(totals.select("avgdl")))  # one row
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    return part.groupBy("query", key).agg(F.sum(F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("score")).where("score > 0")


def scores(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str) -> DataFrame:
    """(query, key, score) over 0 without an index. Texts are split once; from their terms come the frequencies of all
    terms, and postings of the asked ones only."""
    split = written(docs.select(key, tokens(F.col(text)).alias("t")), "terms")
    totals = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl"))
    counts = written(split.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-counts")
    terms = written(query_terms(queries, query_key, query_text), "query-terms")
    each = split.select(key, F.explode("t").alias("term"), F.size("t").alias("dl")).join(terms.select("term").distinct(), "term", "left_semi")
    posted = each.groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return scored(posted, totals, idf_of(counts, totals), terms, key)


def top(scored: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The best k per query, ties by key; scores rounded to 6 digits before ranking."""
    r = scored.withColumn("score", F.round("score", 6))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
