"""A persistent index of files: chunks, postings, term counts, symbol graph and manifest, as segments of Parquet.

A build writes one segment. An update writes another, with what is new or changed, and names the paths that it replaces or
removes; so its size follows the change. Which segments count, and in which order, stands in a log that is only appended
to: a segment that no line of the log names doesn't exist for readers. A row of a segment lives unless a later segment
names its path as gone. Term counts are changes that add up, with those of gone chunks taken off, so a search knows
frequencies without reading postings. Nodes and edges are stored with a segment that stands alone; behind an update they
follow from the living chunks, as a name may now mean another file's symbol. Compaction makes one segment of all.

One writer at a time. Readers see a state of the log, and the files of earlier states stay until vacuum removes them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.code import CHUNK, chunk_files
from . import graph as G
from . import index as I
from . import postings as P
from . import ranking as R
from .shared import written

PARTS = ("chunks", "postings", "manifest", "nodes", "edges")
#: An update that would leave more segments than this compacts them.
SEGMENTS = 8
_SCHEMAS = {"chunks": CHUNK, "postings": "id string, term string, dl int, tf long, file string", "manifest": "path string, hash string", "gone": "path string", "counts": "term string, df long, tokens long, docs long"}
_LOG = "seq int, segment string, base boolean"


def _manifest(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("hash"))


def searchable(chunks: DataFrame) -> DataFrame:
    """Chunks with text; others only carry imports."""
    return chunks.where("content is not null")


def segments(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(seq, segment) that count, in order: from the last one that is a base on."""
    log = sorted(spark.read.schema(_LOG).parquet(f"{root}/log").collect())  # a row for each update since the last vacuum
    last = max(i for i, r in enumerate(log) if r["base"])
    return [(r["seq"], r["segment"]) for r in log[last:]]


def _counted(chunks: DataFrame) -> DataFrame:
    return P.counted(searchable(chunks), ["id", "file"], "content")


def _written(part: DataFrame, path: str) -> None:
    part.write.option("compression", "zstd").parquet(path)


def _counts(posted: DataFrame, chunks: DataFrame, sign: int) -> DataFrame:
    """Changes by term; a row without a term carries the number of chunks."""
    by = P.term_counts(posted).select("term", (sign * F.col("df")).alias("df"), (sign * F.col("tokens")).alias("tokens"), F.lit(0).cast("long").alias("docs"))
    n = searchable(chunks).agg(F.count(F.lit(1)).alias("docs"))
    return by.unionByName(n.select(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("df"), F.lit(0).cast("long").alias("tokens"), (sign * F.col("docs")).alias("docs")))


def _segment(spark: SparkSession, root: str, chunks: DataFrame, files: DataFrame, seq: int, base: bool, gone: DataFrame | None = None, stale: DataFrame | None = None) -> None:
    """Writes a segment of chunks, with files (path, hash) for its manifest, then the line of the log that names it."""
    name = uuid.uuid4().hex
    at = f"{root}/segments/{name}"
    _written(chunks, f"{at}/chunks")
    own = spark.read.schema(CHUNK).parquet(f"{at}/chunks")
    P.write(_counted(own), f"{at}/postings", "id")
    posted = spark.read.schema(_SCHEMAS["postings"] + ", bucket int").parquet(f"{at}/postings").drop("bucket")
    counts = _counts(posted, own, 1)
    if stale is not None:  # what these chunks had added
        # Stale chunks lie by file, so their rows with the same id and dl add up where they are.
        old = P.each(_counted(stale)).groupBy("file", "id", "dl", "term").agg(F.sum("tf").alias("tf"))
        counts = counts.unionByName(_counts(old, stale, -1)).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "tokens", "docs")])
    counts.write.parquet(f"{at}/counts")
    files.join(own.select(F.col("file").alias("path")).distinct(), "path", "left_semi").select("path", "hash").write.parquet(f"{at}/manifest")
    (gone if gone is not None else files.select("path").where("false")).write.parquet(f"{at}/gone")
    if base:
        G.nodes(own).write.parquet(f"{at}/nodes")
        G.edges(own).write.parquet(f"{at}/edges")
    # Last of all, so that a segment counts only when all its parts are there.
    spark.createDataFrame([(seq, name, base)], _LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")


def _part(spark: SparkSession, root: str, known: list[tuple[int, str]], part: str) -> DataFrame:
    """The rows of a part in all segments, with the segment's number."""
    out = None
    for seq, name in known:
        kind = _SCHEMAS[part] + (", bucket int" if part == "postings" else "")
        one = spark.read.schema(kind).parquet(f"{root}/segments/{name}/{part}").drop("bucket").withColumn("_seq", F.lit(seq))
        out = one if out is None else out.unionByName(one)
    return out


def _living(rows: DataFrame, gone: DataFrame, path: str) -> DataFrame:
    """Rows (with _seq) that no later segment names as gone."""
    last = gone.groupBy(F.col("path").alias("_path")).agg(F.max("_seq").alias("_gone"))
    return rows.join(last, F.col(path) == F.col("_path"), "left").where("_gone is null or _seq >= _gone").drop("_path", "_gone", "_seq")


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The parts as they are now."""
    known = segments(spark, root)
    gone = _part(spark, root, known, "gone")
    out = {p: _living(_part(spark, root, known, p), gone, path) for p, path in (("chunks", "file"), ("postings", "file"), ("manifest", "path"))}
    if len(known) == 1:
        return out | {p: spark.read.parquet(f"{root}/segments/{known[0][1]}/{p}") for p in ("nodes", "edges")}
    return out | {"nodes": G.nodes(out["chunks"]), "edges": G.edges(out["chunks"])}


def build(files: DataFrame, root: str) -> None:
    """files (path, content) to a new base; those without chunks are left out of the manifest."""
    spark = files.sparkSession
    try:
        seq = max(s for s, _ in segments(spark, root)) + 1
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        seq = 0
    _segment(spark, root, chunk_files(files), _manifest(files), seq, True)


def update(files: DataFrame, root: str, most: int = SEGMENTS) -> DataFrame:
    """The index as build(files) would make it, parsing and writing only files that are new or have another hash. Returns the
    changes (path, change). Beyond ``most`` segments they are compacted."""
    spark = files.sparkSession
    known = segments(spark, root)
    now = load(spark, root)
    current = _manifest(files)
    changes = written(I.detect_changes(now["manifest"], current), "changes")
    if changes.isEmpty():
        return changes
    gone = changes.where("change <> 'new'").select("path")
    fresh = files.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")
    stale = now["chunks"].join(gone.hint("merge"), F.col("file") == gone["path"], "left_semi")
    _segment(spark, root, chunk_files(fresh), current, known[-1][0] + 1, False, gone, stale)
    if len(known) + 1 > most:
        compact(spark, root)
    return changes


def compact(spark: SparkSession, root: str) -> None:
    """One segment of all that lives."""
    now = load(spark, root)
    _segment(spark, root, now["chunks"], now["manifest"], segments(spark, root)[-1][0] + 1, True)


def vacuum(spark: SparkSession, root: str) -> int:
    """Removes the segments that no reader of the present state needs, and says how many there were."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/segments")
    fs = folder.getFileSystem(conf)
    keep = {name for _, name in segments(spark, root)}
    old = [x.getPath() for x in fs.listStatus(folder) if x.getPath().getName() not in keep]
    for path in old:
        fs.delete(path, True)
    return len(old)


def term_counts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(term, df) of all living chunks, and one row (n, avgdl), from the stored counts alone."""
    counts = _part(spark, root, segments(spark, root), "counts")
    by = counts.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    totals = counts.agg(F.sum("docs").alias("n"), (F.sum("tokens") / F.nullif(F.sum("docs"), F.lit(0))).alias("avgdl"))
    return by, totals


def scores(spark: SparkSession, root: str, queries: DataFrame) -> DataFrame:
    """(query, id, score) over 0 of queries (query, text) by the stored postings: only files of the asked terms are read."""
    terms = written(R.query_terms(queries, "query", "text"), "query-terms")
    known = segments(spark, root)
    gone = _part(spark, root, known, "gone")
    posted = None
    for seq, name in known:
        one = P.for_terms(spark, [f"{root}/segments/{name}/postings"], terms, _SCHEMAS["postings"]).withColumn("_seq", F.lit(seq))
        posted = one if posted is None else posted.unionByName(one)
    posted = _living(posted, gone, "file") if len(known) > 1 else posted.drop("_seq")
    counts, totals = term_counts(spark, root)
    return R.scored(posted, totals, R.idf_of(counts, totals), terms, "id")


def stats(root_parts: dict[str, DataFrame]) -> DataFrame:
    """(type, chunks, files) of a loaded index."""
    return searchable(root_parts["chunks"]).groupBy("type").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file").alias("files"))


def is_ready(spark: SparkSession, root: str) -> bool:
    """Whether an index with chunks is there."""
    try:
        return not searchable(load(spark, root)["chunks"]).isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
