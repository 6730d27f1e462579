"""Queries of the engine's operators over the driver's tables, each with DuckDB SQL of the same result.

Stand-ins: documents are the indexed chunks (file: source, type: lang) and the files read line by line, pages.url gives
file paths, events the tool-call log (session: user_id, order: ts, event_id), conversations the session turns, and
foreign keys of the star schema the symbol graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import output as O
from ..functions import records
from ..functions import text as T
from ..operators import events as E
from ..operators import files as FI
from ..operators import graph as G
from ..operators import index as I
from ..operators import knowledge as K
from ..operators import project as PJ
from ..operators import ranking as R
from ..operators import retrieve as RT
from ..operators import store
from ..operators.shared import shared_path, written
from ..sources import markdown as MD
from ..sources import records as RC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _tok(col: str, stop) -> str:
    return f"list_filter(flatten(list_transform(regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: string_split(w, '_'))), lambda w: length(w) > 2 AND w NOT IN {_list(stop)})"


DT, QT = _tok("text", T.CODE_STOP_WORDS), _tok("text", T.QUERY_STOP_WORDS)

# Ranking


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({DT}) AS term FROM documents) GROUP BY ALL")
def tokenize_counts(spark, sf):
    return R.postings(t(spark, sf, "documents"), "doc_id", "text").select("doc_id", "term", "tf")


@query(f"SELECT doc_id, len({DT}) AS dl FROM documents")
def doc_lengths(spark, sf):
    return R.lengths(t(spark, sf, "documents"), "doc_id", "text")


_P = f"""d AS MATERIALIZED (SELECT doc_id, {DT} AS tk FROM documents), tot AS MATERIALIZED (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM d),
p AS MATERIALIZED (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(tk) AS dl, unnest(tk) AS term FROM d) GROUP BY ALL),
raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM p, tot GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * mean ELSE r END AS idf FROM raw, (SELECT avg(r) AS mean FROM raw))"""


@query(f"""WITH c AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({DT})) AS term FROM documents) GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS r FROM c)
SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END, 6) AS idf FROM raw""")
def idf_table(spark, sf):
    d = t(spark, sf, "documents")
    posted = written(R.postings(d, "doc_id", "text"), "postings")
    return R.idf(posted, R.corpus(d, posted)).withColumn("idf", F.round("idf", 6))


@query(f"SELECT item_id, array_to_string({QT}, ' ') AS tokens FROM benchmark")
def query_tokens(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("tokens"))


_BM25 = f"""WITH {_P}, qt AS (SELECT query, term, count(*) AS qf FROM (SELECT item_id AS query, unnest({QT}) AS term FROM (SELECT * FROM benchmark @WHERE@)) GROUP BY ALL),
s AS (SELECT query, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s0
  FROM p JOIN idf USING (term) JOIN qt USING (term), tot GROUP BY ALL HAVING s0 > 0),
k AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query, doc_id, score, rank FROM k WHERE rank <= 10"""


@query(_BM25.replace("@WHERE@", "").replace("rank <= 10", "rank <= 3"))
def bm25_topk(spark, sf):
    q = t(spark, sf, "benchmark")
    return R.top(R.scores(t(spark, sf, "documents"), q, "doc_id", "text", "item_id", "text"), "doc_id", 3).select("query", "doc_id", "score", "rank")


@query(_BM25.replace("@WHERE@", ""))
def bm25_multi_query(spark, sf):
    return R.top(R.scores(t(spark, sf, "documents"), t(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text"), "doc_id").select("query", "doc_id", "score", "rank")


@query("SELECT lang AS type, count(*) AS chunks, count(DISTINCT source) AS files FROM documents GROUP BY lang")
def corpus_stats(spark, sf):
    return t(spark, sf, "documents").groupBy(F.col("lang").alias("type")).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source").alias("files"))


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS hash FROM documents")
def content_hash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(f"SELECT item_id, array_to_string({_tok('text', T.KEYWORD_STOP_WORDS).replace('lambda w: string_split(w, ' + chr(39) + '_' + chr(39) + ')', 'lambda w: [w]')}, ' ') AS keywords FROM benchmark")
def keywords(spark, sf):
    runs = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return t(spark, sf, "benchmark").select("item_id", F.array_join(F.filter(runs, lambda w: (F.length(w) > 2) & ~w.isin(*T.KEYWORD_STOP_WORDS)), " ").alias("keywords"))


# Files

_LINES = "(SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)"


@query(f"SELECT doc_id, line, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content FROM {_LINES} WHERE regexp_matches(content, '(?i)licen[sc]e')")
def grep_lines(spark, sf):
    return FI.grep(t(spark, sf, "documents"), "doc_id", "text", "licen[sc]e")


@query(f"SELECT doc_id, line, context FROM (SELECT doc_id, line, content, string_agg(content, chr(10)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM {_LINES}) WHERE regexp_matches(content, '(?i)licen[sc]e')")
def grep_context(spark, sf):
    return FI.grep_context(t(spark, sf, "documents"), "doc_id", "text", "licen[sc]e")


_S = "string_split(coalesce(text, ''), chr(10))"


@query(f"SELECT doc_id, array_to_string({_S}[2:4], chr(10)) AS content, len({_S}) AS total_lines, len({_S}[2:4]) AS returned_lines FROM documents")
def read_range(spark, sf):
    return FI.read_range(t(spark, sf, "documents"), "doc_id", "text", 2, 4)


@query("WITH p AS (SELECT doc_id AS path FROM labels UNION ALL SELECT -1 - page_id FROM pages), r AS (SELECT path, text FROM p LEFT JOIN documents ON path = doc_id) SELECT path, text IS NOT NULL AS found, CASE WHEN text IS NULL THEN 'File not found' END AS error, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines FROM r")
def batch_read(spark, sf):
    wanted = t(spark, sf, "labels").select(F.col("doc_id").alias("path")).unionAll(t(spark, sf, "pages").select(-1 - F.col("page_id")))
    return FI.read_batch(wanted, t(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))).select("path", "found", "error", F.col("lines").alias("n_lines"))


@query(f"SELECT doc_id, CASE WHEN len({_S}) > 5 THEN array_to_string({_S}[1:5], chr(10)) || chr(10) || '... (truncated)' ELSE array_to_string({_S}, chr(10)) END AS content FROM documents")
def truncate_lines(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.truncate_lines(F.col("text"), 5).alias("content"))


@query(f"SELECT source, sum(len({_S})) AS total_lines, count(*) AS files FROM documents GROUP BY source")
def line_totals(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(F.sum(F.size(T.lines(F.col("text")))).alias("total_lines"), F.count(F.lit(1)).alias("files"))


@query("SELECT doc_id, text LIKE '%the%' AND text LIKE '%and%' AND text LIKE '%license%' AS valid, list_filter(['the', 'and', 'license'], lambda p: contains(coalesce(text, ''), p)) AS found, list_filter(['the', 'and', 'license'], lambda p: NOT contains(coalesce(text, ''), p)) AS missing FROM documents")
def contains_all(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.contains_all(F.col("text"), ["the", "and", "license"]).alias("v")).select("doc_id", "v.*")


_PATH = "regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1)"


@query(f"SELECT page_id, {_PATH} AS path FROM pages WHERE NOT list_has_any(string_split({_PATH}, '/'), ['en', 'node_modules', 'dist'])")
def ignore_filter(spark, sf):
    p = t(spark, sf, "pages").select("page_id", T.path_of(F.col("url")).alias("path"))
    return p.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ("en", "node_modules", "dist")))))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '[.]com/.*[0-9]$')")
def glob_filter(spark, sf):
    return t(spark, sf, "pages").select("page_id", "url").where(F.col("url").rlike("[.]com/.*[0-9]$"))


_PARTS = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"


@query(f"WITH d AS (SELECT {_PARTS} AS p FROM pages), e AS (SELECT p, unnest(range(1, least(len(p) - 1, 3) + 1)) AS depth FROM d) SELECT DISTINCT array_to_string(p[1:depth], '/') AS prefix, CAST(depth AS INT) AS depth FROM e")
def folder_prefixes(spark, sf):
    return FI.prefixes(t(spark, sf, "pages").select(T.path_of(F.col("url")).alias("path")), "path")


@query(f"SELECT dir, page_id, n FROM (SELECT array_to_string({_PARTS}[1:1], '/') AS dir, page_id, row_number() OVER (PARTITION BY array_to_string({_PARTS}[1:1], '/') ORDER BY page_id) AS n FROM pages) WHERE n <= 30")
def first_n_per_dir(spark, sf):
    p = t(spark, sf, "pages").select("page_id", F.array_join(F.slice(F.filter(F.split(T.path_of(F.col("url")), "/"), lambda x: x != ""), 1, 1), "/").alias("dir"))
    return p.withColumn("n", F.row_number().over(Window.partitionBy("dir").orderBy("page_id"))).where("n <= 30").select("dir", "page_id", "n")


@query("""WITH f AS (SELECT page_id, lower(url) AS path, regexp_extract(lower(url), '([^/]*)$', 1) AS name FROM pages), k AS (SELECT unnest(['en', 'com', 'blog']) AS k),
s AS (SELECT page_id, sum(CASE WHEN contains(path, k) THEN 10 ELSE 0 END + CASE WHEN contains(name, k) THEN 20 ELSE 0 END + CASE WHEN name = k THEN 50 ELSE 0 END) AS score FROM f, k GROUP BY page_id)
SELECT page_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, page_id LIMIT 15""")
def file_score(spark, sf):
    path = F.lower("url")
    name = F.regexp_extract(path, "([^/]*)$", 1)
    score = sum((F.when(path.contains(k), 10).otherwise(0) + F.when(name.contains(k), 20).otherwise(0) + F.when(name == k, 50).otherwise(0) for k in ("en", "com", "blog")), F.lit(0))
    return t(spark, sf, "pages").select("page_id", score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "page_id").limit(15)


@query("WITH e AS (SELECT doc_id AS path FROM labels UNION SELECT -1 - page_id FROM pages) SELECT path, path IN (SELECT doc_id FROM documents) AS found FROM e")
def structure_check(spark, sf):
    wanted = t(spark, sf, "labels").select(F.col("doc_id").alias("path")).unionAll(t(spark, sf, "pages").select(-1 - F.col("page_id")))
    return FI.validate_structure(wanted, t(spark, sf, "documents").select(F.col("doc_id").alias("path")))


# Graph: nation -> region, customer -> nation, supplier -> nation, orders aside


def _edges(spark, sf):
    e = [
        t(spark, sf, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("src"), F.concat(F.lit("region:"), "n_regionkey").alias("dst"), F.lit("inherits").alias("edge_type")),
        t(spark, sf, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.concat(F.lit("nation:"), "c_nationkey").alias("dst"), F.lit("calls").alias("edge_type")),
        t(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("src"), F.concat(F.lit("nation:"), "s_nationkey").alias("dst"), F.lit("references").alias("edge_type")),
    ]
    return e[0].unionByName(e[1]).unionByName(e[2]).distinct()


_INV = {"calls": "called_by", "inherits": "inherited_by", "references": "referenced_by"}
_E = """e AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'inherits' AS edge_type FROM nation
UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'calls' FROM customer UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'references' FROM supplier)"""
_B = f"{_E}, b AS (SELECT * FROM e UNION SELECT dst, src, CASE edge_type WHEN 'calls' THEN 'called_by' WHEN 'inherits' THEN 'inherited_by' ELSE 'referenced_by' END FROM e)"


@query(f"WITH {_B} SELECT * FROM b")
def edges_build(spark, sf):
    return G.with_inverse(_edges(spark, sf), _INV)


def _hops(spark, sf, n):
    return G.neighbors(G.with_inverse(_edges(spark, sf), _INV), spark.createDataFrame([("nation:3",)], "id string"), n)


@query(f"WITH {_B} SELECT DISTINCT dst AS id, 1 AS hop FROM b WHERE src = 'nation:3'")
def neighbors_1hop(spark, sf):
    return _hops(spark, sf, 1)


@query(f"WITH {_B}, h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src = 'nation:3'), h2 AS (SELECT DISTINCT dst AS id FROM b JOIN h1 ON src = h1.id) SELECT id, 1 AS hop FROM h1 UNION SELECT id, 2 FROM h2 WHERE id <> 'nation:3' AND id NOT IN (SELECT id FROM h1)")
def neighbors_2hop(spark, sf):
    return _hops(spark, sf, 2)


def _nodes(edges):
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.upper("id").alias("name"), F.split("id", ":")[0].alias("type"))


def _related(spark, sf, kind):
    both = G.with_inverse(_edges(spark, sf), _INV)
    known = _nodes(both)
    return G.related(both, known, known.select("id"), kind).select("of", "id", "name")


@query(f"WITH {_E} SELECT dst AS of, src AS id, upper(src) AS name FROM e WHERE edge_type = 'calls'")
def callers(spark, sf):
    return _related(spark, sf, "called_by")


@query(f"WITH {_E} SELECT src AS of, dst AS id, upper(dst) AS name FROM e WHERE edge_type = 'calls'")
def callees(spark, sf):
    return _related(spark, sf, "calls")


@query(f"WITH {_B} SELECT src AS id, edge_type, string_agg(upper(dst), ',' ORDER BY upper(dst)) AS names FROM b WHERE edge_type <> 'inherited_by' GROUP BY ALL")
def graph_context(spark, sf):
    b = G.with_inverse(_edges(spark, sf), _INV)
    known = _nodes(b)
    return G.context(b, known, known.select("id")).select("id", "edge_type", F.array_join("names", ",").alias("names"))


@query(f"WITH {_B}, k AS (SELECT DISTINCT src AS id, string_split(src, ':')[1] AS type FROM b) SELECT 'nodes' AS kind, 'all' AS item, count(*) AS n FROM k UNION ALL SELECT 'edges', 'forward', count(*) FROM e UNION ALL SELECT 'type', type, count(*) FROM k GROUP BY type")
def graph_counts(spark, sf):
    b = G.with_inverse(_edges(spark, sf), _INV)
    return G.stats(b, _nodes(b))


@query(f"WITH {_B} SELECT DISTINCT a.src AS start, c.dst AS id FROM b a JOIN b c ON a.dst = c.src WHERE a.edge_type = 'calls' AND c.edge_type = 'inherits'")
def typed_paths(spark, sf):
    b = G.with_inverse(_edges(spark, sf), _INV)
    starts = t(spark, sf, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    return G.reachable(b, starts, 2, ["calls", "inherits"]).where("hop = 2").select("start", "id")


@query(f"WITH {_E} SELECT edge_type, count(*) AS edges, count(DISTINCT src) AS sources FROM e GROUP BY edge_type")
def graph_stats(spark, sf):
    return _edges(spark, sf).groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"))


@query(f"WITH {_E} SELECT * FROM e WHERE NOT starts_with(src, 'supplier:') AND NOT starts_with(dst, 'supplier:')")
def remove_node_prefix(spark, sf):
    return G.remove_prefix(_edges(spark, sf), "supplier:")


# Names: a document is a symbol of its source named by its first word, and calls its second; they are inserted by doc_id

_W = "string_split(coalesce(text, ''), ' ')"
_NAMES = f"s AS (SELECT doc_id, source, {_W}[1] AS name, {_W}[2] AS called FROM documents)"
_RESOLVED = """WITH @NAMES@, h AS (SELECT c.doc_id AS src, s.doc_id AS dst, s.source IS NOT DISTINCT FROM c.source AS own FROM s c JOIN s ON s.name = c.called @BY@),
k AS (SELECT *, bool_or(own) OVER (PARTITION BY src) AS has FROM h) SELECT src, dst FROM k WHERE own OR NOT has""".replace("@NAMES@", _NAMES)


def _resolved(spark, sf, ordered):
    words = F.split(F.coalesce("text", F.lit("")), " ")
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("doc_id").alias("seq"), F.get(words, F.lit(0)).alias("name"), F.get(words, F.lit(1)).alias("called"))
    calls = d.select(F.col("id").alias("src"), "file", "seq", F.col("called").alias("name")).where("name is not null")
    return G.resolve(calls, d.select("id", "file", "seq", "name"), ordered).select("src", "dst")


@query(_RESOLVED.replace("@BY@", "AND s.doc_id <= c.doc_id"))
def names_in_order(spark, sf):
    return _resolved(spark, sf, True)


@query(_RESOLVED.replace("@BY@", ""))
def names_of_all(spark, sf):
    return _resolved(spark, sf, False)


# Index maintenance: labelled documents were indexed, those of poor quality with another text, and so were the pages,
# which are gone

_OLD = "m AS (SELECT doc_id AS path, sha256(CASE WHEN quality = 1 THEN coalesce(text, '') ELSE 'old' END) AS hash FROM labels JOIN documents USING (doc_id) UNION ALL SELECT -1 - page_id, sha256(coalesce(url, '')) FROM pages), c AS (SELECT doc_id AS path, sha256(coalesce(text, '')) AS hash FROM documents)"


def _manifest(spark, sf):
    text, path = F.coalesce("text", F.lit("")), F.col("doc_id").alias("path")
    old = t(spark, sf, "labels").join(t(spark, sf, "documents"), "doc_id").select(path, F.sha2(F.when(F.col("quality") == 1, text).otherwise("old"), 256).alias("hash"))
    gone = t(spark, sf, "pages").select((-1 - F.col("page_id")).alias("path"), F.sha2(F.coalesce("url", F.lit("")), 256).alias("hash"))
    return old.unionByName(gone), t(spark, sf, "documents").select(path, F.sha2(text, 256).alias("hash"))


_CH = f"WITH {_OLD}, x AS (SELECT coalesce(m.path, c.path) AS path, CASE WHEN m.hash IS NULL THEN 'new' WHEN c.hash IS NULL THEN 'deleted' WHEN m.hash <> c.hash THEN 'modified' END AS change FROM m FULL JOIN c ON m.path = c.path)"


@query(f"{_CH} SELECT path, change FROM x WHERE change IS NOT NULL")
def detect_changes(spark, sf):
    return I.detect_changes(*_manifest(spark, sf))


@query(f"{_CH} SELECT count(*) > 0 AS stale FROM x WHERE change IN ('deleted', 'modified')")
def is_stale(spark, sf):
    return I.is_stale(*_manifest(spark, sf))


@query(f"{_CH} SELECT m.path, m.hash FROM m WHERE path NOT IN (SELECT path FROM x WHERE change IS NOT NULL) UNION ALL SELECT c.path, c.hash FROM c WHERE path IN (SELECT path FROM x WHERE change IN ('new', 'modified'))")
def merge_chunks(spark, sf):
    old, now = _manifest(spark, sf)
    ch = I.detect_changes(old, now)
    return I.merge(old, now.join(ch.where("change <> 'deleted'"), "path", "left_semi"), ch.where("change = 'deleted'"), "path")


# A stored index of documents as text files, built from the labelled ones and updated to all; files over 100 KB have no chunk

_CUT = "CASE WHEN len(string_split(text, chr(10))) > 200 THEN array_to_string(string_split(text, chr(10))[1:200], chr(10)) || chr(10) || '... (truncated)' ELSE text END"
_KEPT = f"(SELECT doc_id, {_CUT} AS text FROM documents WHERE strlen(text) <= 102400)"


def _stored(spark, sf):
    root = shared_path(spark, "stored-index")
    files = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    labels = t(spark, sf, "labels").select("doc_id", "quality")
    old = files.join(labels, "doc_id").select("path", F.when(F.col("quality") == 1, F.col("content")).otherwise("an older text").alias("content"))
    gone = t(spark, sf, "pages").select(F.concat(F.lit("p/"), "page_id", F.lit(".txt")).alias("path"), F.col("url").alias("content"))
    store.build(old.unionByName(gone), root)
    store.update(files.select("path", "content"), root)
    return root


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({DT})) AS term FROM {_KEPT}) GROUP BY term")
def stored_terms(spark, sf):
    return store.term_counts(spark, _stored(spark, sf))[0]


@query(_BM25.replace("@WHERE@", "").replace("FROM documents)", f"FROM {_KEPT})").replace("SELECT query, doc_id, score, rank", "SELECT query, 'd/' || doc_id || '.txt:module' AS id, score, rank").replace("ORDER BY score DESC, doc_id)", "ORDER BY score DESC, 'd/' || doc_id || '.txt:module')"))
def stored_search(spark, sf):
    queries = t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    return RT.search(queries, queries, index=_stored(spark, sf)).select("query", "id", "score", "rank")


# Events

_O = ["ts", "event_id"]


@query("SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (value > 50) AS slow, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def tool_summary(spark, sf):
    return t(spark, sf, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("value") > 50).alias("slow"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'error', 'purchase', 'view') THEN event_type ELSE 'error' END AS type, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def event_parse(spark, sf):
    known = F.col("event_type").isin("click", "error", "purchase", "view")
    return t(spark, sf, "events").select("event_id", F.when(known, F.col("event_type")).otherwise("error").alias("type"), F.get_json_object("props", "$.k").cast("long").alias("k"))


# Sign-ups are of no known type, and their data isn't JSON.


@query("""WITH e AS (SELECT *, event_type = 'signup' AS odd FROM events)
SELECT CASE WHEN odd THEN 'error' ELSE event_type END AS type, CASE WHEN NOT odd THEN event_id END AS event_id, CASE WHEN NOT odd THEN CAST(props ->> '$.k' AS BIGINT) END AS k, CASE WHEN odd THEN 'user ' || user_id || ' by "' || event_id || '"' END AS message FROM e""")
def event_source(spark, sf):
    message = F.concat(F.lit("user "), "user_id", F.lit(' by "'), "event_id", F.lit('"'))
    data = F.when(F.col("event_type") == "signup", message).otherwise(F.to_json(F.struct("event_id", "props")))
    path = shared_path(spark, "records")
    t(spark, sf, "events").select(F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), data, F.lit("\n"))).write.text(path)
    RC.register(spark)
    r = spark.read.format("records").load(path).select(records.typed(F.col("event"), F.col("data"), ["click", "error", "purchase", "view"]).alias("r"))
    part = lambda *at: F.get_json_object("r.data", "$." + ".".join(at))
    return r.select("r.type", part("event_id").cast("long").alias("event_id"), F.get_json_object(part("props"), "$.k").cast("long").alias("k"), part("message").alias("message"))


@query("SELECT event_id, user_id FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM events) WHERE n = 0")
def terminal_cut(spark, sf):
    return E.until_terminal(t(spark, sf, "events"), "user_id", _O, F.col("event_type") == "purchase").select("event_id", "user_id")


@query("WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM events) SELECT event_id, CAST(segment AS BIGINT) AS segment, row_number() OVER (PARTITION BY user_id, segment ORDER BY ts, event_id) AS place FROM s")
def tool_count_reset(spark, sf):
    return E.running_since(t(spark, sf, "events"), "user_id", _O, F.col("event_type") == "signup").select("event_id", "segment", "place")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def milestone_latest(spark, sf):
    return E.latest(t(spark, sf, "events"), ["user_id", "event_type"], _O, "event_id")


# A call is a click, its id the user and the number in props; a purchase or an error with that id ends it. The SQL follows the
# rule: each end looks for the latest call before it, and of the ends that look for one call the first has it.

_PAIR = """WITH e AS (SELECT user_id, props ->> '$.k' AS call_id, event_id, event_type, epoch_us(ts) // 1000 AS ms, row_number() OVER (ORDER BY ts, event_id) AS o FROM events),
a AS (SELECT * FROM e WHERE event_type = 'click'), b AS (SELECT * FROM e WHERE event_type IN ('error', 'purchase')),
m AS (SELECT a.event_id, b.ms AS done_ms, b.event_type = 'purchase' AS success, b.o FROM b ASOF JOIN a ON b.user_id = a.user_id AND b.call_id = a.call_id AND b.o >= a.o),
f AS (SELECT event_id, min(done_ms) AS done_ms, arg_min(success, o) AS success FROM m GROUP BY event_id)
SELECT event_id, user_id, call_id, ms AS called_ms, done_ms, floor((done_ms - ms + 5) / 10.0) / 100.0 AS seconds, success FROM a LEFT JOIN f USING (event_id)"""


def _pairs(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("call_id"), "event_type", F.col("ts").alias("at"))
    ends = e.where("event_type in ('error', 'purchase')").withColumn("success", F.col("event_type") == "purchase")
    return E.pair_calls(e.where("event_type = 'click'").drop("event_type"), ends, ["user_id", "call_id"], ("event_id",))


@query(_PAIR)
def call_pairing(spark, sf):
    return _pairs(spark, sf).select("event_id", "user_id", "call_id", D.epoch_ms(F.col("at")).alias("called_ms"), D.epoch_ms(F.col("done_at")).alias("done_ms"), "seconds", "success")


@query(f"SELECT event_id, user_id, call_id, called_ms FROM ({_PAIR}) WHERE done_ms IS NULL")
def open_calls(spark, sf):
    return E.open_calls(_pairs(spark, sf)).select("event_id", "user_id", "call_id", D.epoch_ms(F.col("at")).alias("called_ms"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY seen_at) AS seen FROM (SELECT user_id, event_type, min((ts, event_id)) AS seen_at FROM events GROUP BY ALL) GROUP BY user_id")
def first_seen_files(spark, sf):
    return E.first_seen(t(spark, sf, "events"), "user_id", "event_type", _O)


@query("SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id")
def session_summary(spark, sf):
    err = F.when(F.col("event_type") == "error", F.struct(*_O))
    return t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_type").alias("kinds"), F.max_by("event_id", err).alias("last_error"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS b FROM f WHERE n <= 50)
SELECT conv_id, string_agg(role || ': ' || substr(coalesce(text, ''), 1, CASE role WHEN 'user' THEN 200 WHEN 'assistant' THEN 100 ELSE 150 END), chr(10) ORDER BY n) AS context FROM k WHERE b <= 10 GROUP BY conv_id""")
def resume_context(spark, sf):
    cut = F.expr("case role when 'user' then 200 when 'assistant' then 100 else 150 end")
    c = t(spark, sf, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).where("n <= 50")
    c = c.withColumn("b", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n")))).where("b <= 10")
    line = F.struct("n", F.concat("role", F.lit(": "), F.substr(F.coalesce("text", F.lit("")), F.lit(1), cut)).alias("x"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["x"]), "\n").alias("context"))


# Output and edits


_SAID = "CASE event_type WHEN 'click' THEN 'pip install x' WHEN 'view' THEN 'python -m pytest' WHEN 'signup' THEN 'pytest -q' WHEN 'purchase' THEN 'tsc -p x' ELSE 'ls' END || ' ' || user_id"


@query(f"""WITH c AS (SELECT event_id, {_SAID} AS command FROM events)
SELECT event_id, CASE WHEN command LIKE '%pip install%' THEN 'install' WHEN command LIKE '%python %' THEN 'run' WHEN command LIKE '%pytest%' THEN 'test' WHEN command LIKE '%tsc%' THEN 'build' ELSE 'default' END AS class FROM c""")
def command_class(spark, sf):
    return t(spark, sf, "events").select("event_id", T.command_class(F.expr(_SAID)).alias("class"))


_COMMANDS = {"en": "pip install x", "de": "python -m x", "fr": "pytest -q", "es": "tsc -p x"}
_KIND = "CASE lang WHEN 'en' THEN 'install' WHEN 'de' THEN 'run' WHEN 'fr' THEN 'test' WHEN 'es' THEN 'build' ELSE 'default' END"


def _output_sql() -> str:
    by = " ".join(f"WHEN '{k}' THEN regexp_matches(l, '(?i){'|'.join(O.KEPT[k])}') OR NOT regexp_matches(l, '{'|'.join(f'(?:{p})' for p in O.NOISE[k])}')" for k in O.NOISE)
    limit = "CASE kind " + " ".join(f"WHEN '{k}' THEN CASE WHEN ok THEN {a} ELSE {b} END" for k, (a, b) in O.LIMITS.items()) + " END"
    head = "substr(j, 1, lim)"
    last = f"lim - strpos(reverse({head}), chr(10))"
    return f"""WITH d AS (SELECT doc_id, {_KIND} AS kind, doc_id % 2 = 0 AS ok, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS x FROM documents),
l AS (SELECT *, CASE WHEN x = '' THEN [] ELSE string_split(CASE WHEN suffix(x, chr(10)) THEN left(x, length(x) - 1) ELSE x END, chr(10)) END AS l FROM d),
k AS (SELECT *, list_filter(l, lambda l: regexp_matches(l, '\\S') AND CASE kind {by} ELSE true END) AS k FROM l), j AS (SELECT *, array_to_string(k, chr(10)) AS j, {limit} AS lim FROM k)
SELECT doc_id, CASE WHEN length(j) <= lim THEN j ELSE (CASE WHEN contains({head}, chr(10)) AND {last} > lim * 0.8 THEN substr(j, 1, {last}) ELSE {head} END) || chr(10) || '... (truncated)' END AS output,
kind AS command_type, len(l) AS original_lines, len(k) AS filtered_lines, length(j) > lim AS truncated, lim AS limit_applied FROM j"""


@query(_output_sql())
def noise_filter(spark, sf):
    command = F.lit("ls")
    for lang, c in _COMMANDS.items():
        command = F.when(F.col("lang") == lang, c).otherwise(command)
    return t(spark, sf, "documents").select("doc_id", O.shell_output(F.col("text"), command, F.col("doc_id") % 2 == 0).alias("o")).select("doc_id", "o.*")


@query("""SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE (CASE WHEN contains(substr(text, 1, 500), chr(10)) AND 500 - strpos(reverse(substr(text, 1, 500)), chr(10)) > 400
THEN substr(text, 1, 500 - strpos(reverse(substr(text, 1, 500)), chr(10))) ELSE substr(text, 1, 500) END) || chr(10) || '... (truncated)' END AS output FROM documents""")
def smart_truncate(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.smart_truncate(F.col("text"), 500).alias("output"))


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'search_code' WHEN 'signup' THEN 'write_file' WHEN 'purchase' THEN 'shell' ELSE 'other' END AS tool, event_type <> 'error' AND value <= 50 AS success FROM events)
SELECT event_id, success, CASE tool WHEN 'shell' THEN 'shell_test' ELSE tool END AS output_type, CASE tool WHEN 'read_file' THEN 80 WHEN 'search_code' THEN 75 WHEN 'write_file' THEN 30 WHEN 'shell' THEN 70 ELSE 50 END + CASE WHEN success THEN 0 ELSE 20 END AS priority FROM e""")
def output_tag(spark, sf):
    tool = F.lit("other")
    for kind, name in (("view", "read_file"), ("click", "search_code"), ("signup", "write_file"), ("purchase", "shell")):
        tool = F.when(F.col("event_type") == kind, name).otherwise(tool)
    tag = O.tag(tool, F.lit("pytest -q"), F.col("value") <= 50, F.when(F.col("event_type") == "error", "failed"))
    return t(spark, sf, "events").select("event_id", tag.alias("t")).select("event_id", "t.success", "t.output_type", "t.priority")


@query("SELECT doc_id, CASE WHEN contains(text, 'the') THEN replace(text, 'the', 'an') ELSE text END AS content, CASE WHEN contains(text, 'the') THEN CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INT) ELSE 0 END AS replacements, CASE WHEN text IS NULL THEN 'File not found' WHEN NOT contains(text, 'the') THEN 'Search text not found' END AS error FROM documents")
def edit_all(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.edited(F.col("text"), F.lit("the"), F.lit("an"), every=True).alias("e")).select("doc_id", "e.*")


@query("SELECT doc_id, CASE WHEN strpos(text, 'the') = 0 THEN text ELSE substr(text, 1, strpos(text, 'the') - 1) || 'THE' || substr(text, strpos(text, 'the') + 3) END AS content FROM documents")
def replace_first(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.replace_first(F.col("text"), "the", "THE").alias("content"))


@query("SELECT doc_id, replace(text, 'the', 'THE') AS content, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INT) AS n FROM documents")
def replace_all(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("the"), F.lit("THE")).alias("content"), T.occurrences(F.col("text"), "the").alias("n"))


@query(f"SELECT doc_id, line, substr(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), 1, 200) AS content FROM {_LINES} WHERE regexp_matches(content, '(?i)^the .*[.]$')")
def grep_anchored(spark, sf):
    return FI.grep(t(spark, sf, "documents"), "doc_id", "text", "^the .*[.]$").select("doc_id", "line", F.substring("content", 1, 200).alias("content"))


# Knowledge base: documents with the language as tag, the source as topic, the first line as title


@query("""WITH d AS (SELECT doc_id, lower(string_split(coalesce(text, ''), chr(10))[1]) AS title, lower(coalesce(source, '')) AS topic, coalesce(lang, '') AS tag, lower(coalesce(text, '')) AS body FROM documents)
SELECT doc_id AS id, CASE WHEN contains(title, 'the src1 de') THEN 100 WHEN contains(title, 'the') OR contains(title, 'src1') OR contains(title, 'de') THEN 50 ELSE 0 END
 + CASE WHEN contains(topic, 'the src1 de') THEN 80 WHEN contains(topic, 'the') OR contains(topic, 'src1') OR contains(topic, 'de') THEN 30 ELSE 0 END
 + CASE WHEN tag = 'the src1 de' THEN 60 WHEN tag IN ('the', 'src1', 'de') THEN 40 ELSE 0 END + CASE WHEN contains(body, 'the src1 de') THEN 20 ELSE 0 END + (doc_id % 70) // 10 AS score
FROM d WHERE score > 0 ORDER BY score DESC, id LIMIT 20""")
def kb_score(spark, sf):
    first = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), first.alias("title"), F.array("source").alias("topics"), F.array("lang").alias("tags"), F.col("text").alias("full_content"), (F.col("doc_id") % 70).alias("priority"))
    return K.search(d, "The src1 DE", limit=20).select("id", "score")


@query("SELECT DISTINCT lang AS tag FROM documents WHERE lang IS NOT NULL")
def kb_tags(spark, sf):
    return t(spark, sf, "documents").select(F.col("lang").alias("tag")).where("tag is not null").distinct()


@query("""WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents)
SELECT source, doc_id, CAST(upto AS BIGINT) AS upto FROM r WHERE upto <= 50000""")
def budget_pack(spark, sf):
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, sf, "documents").select("source", "doc_id", F.sum("n_chars").over(w).alias("upto")).where("upto <= 50000")


@query(f"SELECT doc_id, line, CAST(sum(CASE WHEN regexp_matches(content, '[.]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM {_LINES}")
def section_ids(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    n = FI.numbered(t(spark, sf, "documents"), "doc_id", "text")
    return n.select("doc_id", "line", F.sum(F.col("content").rlike("[.]$").cast("int")).over(w).alias("section"))


# Markdown: a line that begins with a capital D or T is a heading, one with an E or L a fence

_MD = "regexp_replace(regexp_replace(coalesce(text, ''), '(^|\\n)([DT])', '\\1## \\2', 'g'), '(^|\\n)([EL])', '\\1```\\2', 'g')"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split({_MD}, chr(10))) AS x, generate_subscripts(string_split({_MD}, chr(10)), 1) AS n, len(string_split({_MD}, chr(10))) AS total FROM documents),
f AS (SELECT *, starts_with(x, '```') AS fence, coalesce(sum(CASE WHEN starts_with(x, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM l),
h AS (SELECT *, NOT fence AND NOT inside AND regexp_matches(x, '^#{{1,6}}[ \t]+.') AS head FROM f),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS part FROM h)
SELECT doc_id, CAST(min(n) AS INT) AS start_line, CAST(CASE WHEN part = max(any_value(part)) OVER (PARTITION BY doc_id) THEN any_value(total) ELSE max(n) END AS INT) AS end_line,
 trim(regexp_replace(arg_min(x, n), '^#+', '')) AS heading, CAST(count(*) FILTER (fence AND inside) AS INT) AS blocks FROM s WHERE part > 0 GROUP BY doc_id, part""")
def markdown_sections(spark, sf):
    made = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"(^|\n)([DT])", "$1## $2"), r"(^|\n)([EL])", "$1```$2")
    each = t(spark, sf, "documents").select("doc_id", F.explode(MD.section_list(made)).alias("s"))
    return each.select("doc_id", "s.start_line", "s.end_line", "s.heading", F.size("s.code_blocks").alias("blocks"))


@query(f"""WITH p AS (SELECT DISTINCT {_PARTS} AS p FROM pages WHERE len({_PARTS}) > 0), e AS (SELECT p[1:d] AS p, bool_or(d < len(p)) AS is_dir FROM (SELECT p, unnest(range(1, least(len(p), 5) + 1)) AS d FROM p) GROUP BY p[1:d]),
r AS (SELECT *, row_number() OVER (PARTITION BY p[1:len(p) - 1] ORDER BY is_dir DESC, lower(p[len(p)]), p[len(p)]) AS place, count(*) OVER (PARTITION BY p[1:len(p) - 1]) AS n FROM e),
k AS (SELECT * FROM r WHERE place <= 30), a AS (SELECT k.p, k.is_dir, list(u.place ORDER BY len(u.p)) AS walk, list(u.place = u.n ORDER BY len(u.p)) AS ends FROM k JOIN k u ON k.p[1:len(u.p)] = u.p AND len(u.p) <= len(k.p) GROUP BY ALL HAVING count(*) = len(k.p)),
o AS (SELECT *, row_number() OVER (ORDER BY walk) AS position FROM a)
SELECT 0 AS position, 'site/' AS line UNION ALL SELECT CAST(position AS INT), array_to_string(list_transform(ends[1:len(ends) - 1], lambda x: CASE WHEN x THEN '    ' ELSE '│   ' END), '') || CASE WHEN ends[len(ends)] THEN '└── ' ELSE '├── ' END || p[len(p)] || CASE WHEN is_dir THEN '/' ELSE '' END
FROM o WHERE position < 200""")
def drawn_tree(spark, sf):
    return PJ.skeleton_tree(t(spark, sf, "pages").select(T.path_of(F.col("url")).alias("path")), "site")
