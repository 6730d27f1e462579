"""Retrieval: the best chunks of a query, the symbols around them, and what relates them.

Hits are at most a few dozen rows for each query; whatever is joined to them stays as large as the graph, and is met by
joins that Spark may broadcast the hits in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G
from . import knowledge as K
from . import ranking as R
from . import store
from .shared import written

#: What a search tool allows at most.
TOOL_HOPS, TOOL_CHUNKS = 2, 20


def around(hits: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 1, max_signatures: int | None = 20) -> DataFrame:
    """(query, id, position, signature): the nodes around hits (query, id, rank), hit by hit in rank order, each hit's
    nearest first, ties by id; each node once, none that is a hit; the first max_signatures of each query."""
    if hops < 1:
        return hits.select("query", "id", F.lit(0).alias("position"), F.lit("").alias("signature")).where("false")
    near = G.reachable(edges, hits.select("id"), hops, known=nodes)
    met = hits.select("query", F.col("id").alias("start"), "rank").join(near, "start").join(hits.select("query", "id"), ["query", "id"], "left_anti")
    first = met.groupBy("query", "id").agg(F.min(F.struct("rank", "hop")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("at.rank", "at.hop", "id"))
    out = first.withColumn("position", place).join(nodes.select("id", "signature"), "id").select("query", "id", "position", "signature")
    return out if max_signatures is None else out.where(F.col("position") <= max_signatures)


def placed(hits: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 1, max_signatures: int | None = 20) -> DataFrame:
    """hits (query, id, rank) to (query, id, kind, position, signature): the hits as 'chunk' by rank, then what is
    :func:`around` them as 'signature'. Hits without a query are those of one. Hits and result are written, as what made the hits
    would otherwise run again for each of their uses."""
    hits = written(hits if "query" in hits.columns else hits.withColumn("query", F.lit("")), "hits")
    more = around(hits, edges, nodes, hops, max_signatures)
    own = hits.join(nodes.select("id", "signature"), "id", "left").select("query", "id", F.lit("chunk").alias("kind"), F.col("rank").alias("position"), "signature")
    return written(own.unionByName(more.withColumn("kind", F.lit("signature"))), "placed")


def with_contexts(found: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A result of :func:`placed` and, with each row, the names that it is related to by relation, as a map; nodes without a
    name go by their id. With a hub, whose names grow with the graph, a row comes once for each part of its context
    (:func:`graph.context_parts`), numbered from 0 in ``part``: those with part 0 are each row once."""
    name = F.coalesce("name", "id") if "name" in nodes.columns else F.col("id")
    shown = G.context_parts(edges, nodes.withColumn("name", name), found.select("id")).withColumnRenamed("id", "of")
    return found.join(shown, F.col("id").eqNullSafe(F.col("of"))).select("query", "id", "kind", "position", "signature", "context", "part")


def related(found: DataFrame) -> DataFrame:
    """A result of :func:`retrieve`, each row once, with how many names its context shows over all parts (related)."""
    names = F.aggregate(F.map_values("context"), F.lit(0), lambda n, x: n + F.size(x))
    return found.groupBy("query", "id", "kind", "position", "signature").agg(F.coalesce(F.sum(names), F.lit(0)).alias("related"))


def with_related(found: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A result of :func:`placed` and, with each row, how many names its context shows (related)."""
    return related(with_contexts(found, edges, nodes))


def retrieve(hits: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 1, max_signatures: int | None = 20) -> DataFrame:
    """(query, id, kind, position, signature, context, part): what is :func:`placed` for hits (query, id, rank), :func:`with_contexts`."""
    return with_contexts(placed(hits, edges, nodes, hops, max_signatures), edges, nodes)


def with_documents(found: DataFrame, queries: DataFrame, docs: DataFrame, max_docs: int = 3) -> DataFrame:
    """A result of :func:`retrieve` for queries (query, text), and as 'document' by rank the best documents of the knowledge base
    (as operators.knowledge.documents) for each; their signature is the title, their context and part null."""
    best = K.search_many(docs, queries, max_docs).join(docs.select("id", F.col("title").alias("signature")), "id")
    own = best.select("query", "id", F.lit("document").alias("kind"), F.col("rank").alias("position"), "signature")
    return found.unionByName(own, allowMissingColumns=True)


def document_contexts(found: DataFrame, docs: DataFrame, max_chars: int = 2000) -> DataFrame:
    """(query, context): the documents of a result of :func:`with_documents`, laid out; no row for a query without any."""
    return K.contexts(found.where("kind = 'document'").select("query", "id", F.col("position").alias("rank")), docs, max_chars)


# The counters of a result, and the kind of row that each counts.
COUNTERS = {"bm25_hits": "chunk", "expanded_symbols": "signature", "total_chunks": "chunk", "total_signatures": "signature", "kb_docs_found": "document"}


def _rows(found: DataFrame, kind: str) -> Column:
    """How many rows of a kind, each once however many parts its context has."""
    own = F.col("kind") == kind
    return F.count_if(own & (F.coalesce("part", F.lit(0)) == 0) if "part" in found.columns else own)


def counters(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, and each of COUNTERS) of a result of :func:`with_documents` for each of queries (query), 0 where nothing was found."""
    n = found.groupBy("query").agg(*[_rows(found, kind).alias(c) for c, kind in COUNTERS.items()])
    return queries.select("query").join(n, "query", "left").na.fill(0, list(COUNTERS))


def counts(found: DataFrame) -> DataFrame:
    """(query, total_chunks, total_signatures) of a result of :func:`retrieve`."""
    return found.groupBy("query").agg(_rows(found, "chunk").alias("total_chunks"), _rows(found, "signature").alias("total_signatures"))


def exact_hits(hits: DataFrame, queries: DataFrame, best: int = 5, fallback: int = 3) -> DataFrame:
    """Of hits (query, id, rank, name) the ``best`` whose name is the query's text (queries: query, text), whatever the case;
    without any, the first ``fallback``."""
    own = hits.where(F.col("rank") <= best).join(queries.select("query", F.lower(F.trim("text")).alias("wanted")), "query")
    exact = F.coalesce(F.lower("name") == F.col("wanted"), F.lit(False))
    found = F.max("exact").over(Window.partitionBy("query"))  # at most `best` rows of a query
    return own.withColumn("exact", exact).withColumn("found", found).where(F.when(F.col("found"), F.col("exact")).otherwise(F.col("rank") <= fallback)).drop("exact", "found", "wanted")


def search(chunks: DataFrame, queries: DataFrame, k: int = 10, index: str | None = None) -> DataFrame:
    """(query, id, rank, score): the best k chunks (id, content) of each of queries (query, text). With the root of a stored
    index its postings are read, of the asked terms only, instead of the chunks' texts."""
    found = R.scores(chunks, queries, "id", "content", "query", "text") if index is None else store.scores(queries.sparkSession, index, queries)
    return R.top(found, "id", k).select("query", "id", "rank", "score")


def retrieve_symbol(chunks: DataFrame, edges: DataFrame, nodes: DataFrame, queries: DataFrame, hops: int = 1, index: str | None = None) -> DataFrame:
    """As :func:`retrieve`, of the best five chunks those that are named as the query says, or the first three; all around."""
    hits = search(chunks, queries, 5, index).join(chunks.select("id", "name"), "id")
    return retrieve(exact_hits(hits, queries).select("query", "id", "rank"), edges, nodes, hops, None)


def retrieve_for_file(chunks: DataFrame, edges: DataFrame, nodes: DataFrame, file: str, hops: int = 1) -> DataFrame:
    """As :func:`retrieve`, for all chunks of a file in the order of their lines, and all that is around them."""
    own = chunks.where(F.col("file") == file).select("id", "line_start").distinct()
    place = F.row_number().over(Window.partitionBy("query").orderBy("line_start", "id"))  # the chunks of one file
    return retrieve(own.withColumn("query", F.lit(file)).withColumn("rank", place).select("query", "id", "rank"), edges, nodes, hops, None)


def search_code(
    chunks: DataFrame, edges: DataFrame, nodes: DataFrame, queries: DataFrame, hops: int = 1, k: int = 10, index: str | None = None, docs: DataFrame | None = None
) -> DataFrame:
    """The search tool: :func:`retrieve` of the best k chunks, with hops and k cut to what the tool allows, and
    :func:`with_documents` where there is a knowledge base."""
    found = retrieve(search(chunks, queries, min(k, TOOL_CHUNKS), index).select("query", "id", "rank"), edges, nodes, min(hops, TOOL_HOPS))
    return found if docs is None else with_documents(found, queries, docs)


def knowledge(docs: DataFrame, query: str, limit: int = 3, max_chars: int = 2000) -> DataFrame:
    """One row (context): the best documents of the knowledge base for the query, laid out; empty without any."""
    return K.format_context(K.search(docs, query, limit=limit), [F.desc("score"), "id"], max_chars)


def by_id(rows: DataFrame, value: str, column: str = "id") -> DataFrame:
    """The rows of a chunk, node or edge table for an id or file."""
    return rows.where(F.col(column) == value)
