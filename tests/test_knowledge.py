import functools
import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import events as E
from quarryline.operators import graph as G
from quarryline.operators import knowledge as K
from quarryline.operators import project as PR
from quarryline.operators import retrieve as RT
from quarryline.operators import sessions as S
from quarryline.plans import queries as Q
from quarryline.streaming import sessions as SS

ONE = "---\ntags:\n  - API\n  - 'x y'\npriority: 70\nsummary: \"Short\"\n---\nlost\n# Top\nfirst\n\nsecond\n```PY\nprint(1)\n```\n## Two\nmore\n### Deep\n```sql\nselect\n```\n"
FILES = [("kb/a/my_doc.md", ONE), ("kb/plain-page.md", "## Only\n" + "p" * 300 + "\n\nq"), ("kb/none.md", None)]


def docs(spark):
    return K.documents(spark.createDataFrame(FILES, "path string, content string"), "kb")


def test_documents_and_lookups(spark):
    got = {r.id: r for r in docs(spark).collect()}
    a, b, c = (got[p] for p, _ in FILES)
    assert (a.title, a.tags, a.topics, a.summary, a.priority) == ("Top", ["a", "api", "my-doc", "x y"], ["Top", "Two"], "Short", 70)
    assert [(s.heading, s.start_line, s.end_line) for s in a.sections] == [("Top", 2, 8), ("Two", 9, 10), ("Deep", 11, 14)]
    assert (b.title, b.tags, b.summary, b.priority) == ("Plain-Page", ["plain-page"], "p" * 200, 50)
    assert (c.title, c.topics, c.summary, c.full_content) == ("None", [], "", "")
    one = docs(spark).where("priority = 70")
    r = one.select(K.section(F.col("sections"), "tWO").alias("s"), K.section(F.col("sections"), "no").alias("n"), K.code_examples(F.col("sections"), "py").alias("c"), K.code_examples(F.col("sections")).alias("all")).first()
    assert r.s.content == "more" and r.n is None and [x.code for x in r.c] == ["print(1)"] and len(r["all"]) == 2


def block(doc, limit):
    out = [f"## {doc.title}"] + ([f"\n{doc.summary}"] if doc.summary else [])
    used = sum(map(len, out))
    for s in doc.sections:
        text = f"\n### {s.heading}\n{s.content}" + "".join(f"\n```{c.language}\n{c.code}\n```" for c in s.code_blocks[:2] if len(c.code) < 500)
        if used + len(text) > limit:
            break
        out.append(text)
        used += len(text)
    return "\n".join(out)


def test_context_blocks_fit_their_budget(spark):
    d = docs(spark)
    for limit in (0, 40, 65, 80, 2000):
        got = {r.id: r.block for r in d.select("id", K.context_block(F.col("title"), F.col("summary"), F.col("sections"), limit).alias("block")).collect()}
        assert got == {r.id: block(r, limit) for r in d.collect()}
    rows = sorted(d.collect(), key=lambda r: r.id)
    for limit in (240, 420, 3000):
        want, used = ["== PROJECT KB DOCS =="], len("== PROJECT KB DOCS ==")
        for r in rows:
            if limit - used - 50 < 200:
                break
            want.append(block(r, limit - used - 50))
            used += len(want[-1])
        assert K.format_context(d, ["id"], limit).first().context == "\n\n".join([*want, "== END KB DOCS =="])
    assert K.format_context(d.where("false"), ["id"]).first().context == ""


def test_budget_by_tags(spark):
    rows = [("a", ["T"], 1, "x" * 1000), ("b", ["t", "u"], 5, "x" * 1500), ("c", ["t"], 1, "x" * 900), ("d", ["v"], 9, "x"), ("e", ["t"], 0, ""), ("f", None, 9, "x")]
    d = spark.createDataFrame(rows, "id string, tags array<string>, priority int, full_content string")
    ids = lambda n: sorted(r.id for r in K.by_tags(d, ["t"], n).collect())
    assert ids(3400) == ["a", "b", "c", "e"] and ids(3200) == ["a", "b", "c"] and ids(2600) == ["a", "b"] and ids(400) == []
    assert K.by_tags(d, []).count() == 0


def test_collected_context(spark):
    rows = [("package.json", "{}"), ("src/loader.py", "l"), ("src/other.py", "o"), ("main.py", "m"), ("node_modules/loader.py", "n"), ("yarn.lock", "y"), ("a.bin", "b")]
    f = spark.createDataFrame(rows, "path string, content string")
    got = [r.path for r in PR.collect_context(f, "Please fix the loader").collect()]
    assert got == ["package.json", "src/loader.py", "main.py", "src/other.py"]
    assert [r.path for r in PR.collect_context(f, "Please fix the loader", limit=2).collect()] == ["package.json", "src/loader.py"]
    small = f.where("path in ('a.bin', 'main.py', 'notes.rst')").union(spark.createDataFrame([("notes.rst", "z")], f.schema))
    assert [r.path for r in PR.collect_context(small, "nothing").collect()] == ["main.py", "notes.rst"]
    assert PR.collect_context(f.where("false"), "x").count() == 0


def run(df, mode, where):
    out = []
    q = df.writeStream.foreachBatch(lambda d, _: out.extend(d.collect())).outputMode(mode).option("checkpointLocation", str(where)).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_session_state_carries_over(spark, tmp_path):
    schema = "session string, seq int, type string, name string, index int, status string"
    parts = [[("s", 1, "plan", "a\nb", None, None), ("s", 2, "worker_start", None, None, None), ("s", 3, "tool", None, None, None), ("t", 1, "tool", None, None, None)], [("s", 4, "worker_done", None, None, None), ("s", 5, "phase", "b", None, "running"), ("s", 6, "tool", None, None, None), ("s", 7, "tool", None, None, None), (None, 1, "plan", "z", None, None), (None, 2, "tool", None, None, None)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = run(SS.track_phases(stream), "update", tmp_path / "check")
    want = S.track_phases(spark.createDataFrame(parts[0] + parts[1], schema)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, want), key=repr)
    assert ("s", 1, "b", "running", True, 2) in set(map(tuple, want)) and (None, 0, "z", "pending", True, 1) in set(map(tuple, want))


def test_records_across_batches(spark, tmp_path):
    text = ["event: a", "data: 1", "data: 2", "", "event: b", "data: 3", "", "data: lost", "", "event: c", "data: 4", ""]
    schema = "stream string, seq int, line string"
    got = []
    for i, (lo, hi) in enumerate([(0, 2), (2, 6), (6, 12)]):
        spark.createDataFrame([("s", n, text[n]) for n in range(lo, hi)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got += run(SS.sse_records(stream), "append", tmp_path / "check")
    batch = E.framed(spark.createDataFrame([("s", n, x) for n, x in enumerate(text)], schema), "stream", "seq", "line").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) == [("s", "a", "1\n2"), ("s", "b", "3"), ("s", "c", "4")]


KB = [
    ("a", "Loader guide", ["Read files"], ["io"], "how to load", 50), ("b", "Other", ["loader"], ["loader"], "the loader guide says", 0), ("c", None, None, None, None, None),
    ("d", "Zebra", [], [], "", 90), ("e", "yak", ["x"], ["guide"], "nothing", 9), ("f", "Fox", [], [], "loader guide", 90),
]


@pytest.mark.parametrize("block", [1, 2, 64])
def test_many_queries_find_what_one_finds(spark, block):
    docs = spark.createDataFrame(KB, "id string, title string, topics array<string>, tags array<string>, full_content string, priority int").withColumn("extra", F.lit(1))
    texts = ["loader guide", "LOADER", "zz", "", " guide  yak ", None, "load\u00a0x"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query int, text string")
    for limit in (1, 3, 9):
        got = {}
        for r in K.search_many(docs, queries, limit, block).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((r.id, r.score, r["rank"]))
        for i, q in enumerate(texts):
            want = [(r.id, r.score, n) for n, r in enumerate(K.search(docs, q or "", limit=limit).collect(), 1)]
            assert got.get(i, []) == want, (limit, q)
    assert K.search_many(docs.where("false"), queries).count() == 0 and K.search_many(docs, queries.where("false")).count() == 0


def test_many_queries_on_random_texts(spark):
    rng = random.Random(5)
    words = ["a", "ab", "bc", "", "\u00a0", "x\ny", "\u00e9", "abc", "\tb"]
    text = lambda n: " ".join(rng.choices(words, k=rng.randint(0, n)))
    rows = [(i, text(4), [text(3) for _ in range(rng.randint(0, 2))], rng.sample([*words, None], 2), text(12), rng.choice([None, -20, 0, 10, 90])) for i in range(120)]
    docs = spark.createDataFrame(rows, "id long, title string, topics array<string>, tags array<string>, full_content string, priority int").repartition(3)
    queries = spark.createDataFrame([(i, text(5).upper()) for i in range(40)], "query int, text string")
    got = {}
    for r in K.search_many(docs, queries, 4, 16).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.score))
    for q in queries.collect()[::4]:
        assert got.get(q.query, []) == [(r.id, r.score) for r in K.search(docs, q.text, limit=4).collect()], q


def test_documents_are_not_shuffled_for_many_queries(spark):
    text = F.concat(F.lit("loader "), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40))
    docs = spark.range(4000).select("id", text.alias("title"), F.array().cast("array<string>").alias("topics"), F.array().cast("array<string>").alias("tags"), text.alias("full_content"), F.lit(0).alias("priority"))
    queries = spark.range(130).select(F.col("id").alias("query"), F.lit("loader x").alias("text"))
    assert "Exchange hashpartitioning(block" not in K.search_many(docs, queries)._jdf.queryExecution().toString()
    assert K.search_many(docs, queries).where("id = rank - 1").count() == 390


def test_related_names_are_counted_as_they_are_shown(spark):
    edges = spark.createDataFrame([("x", "h", "references"), ("h", "x", "referenced_by"), ("h", "y", "referenced_by"), ("h", "gone", "referenced_by"), ("h", "y", "calls"), ("h", "y", "imports")], "src string, dst string, edge_type string")
    nodes = spark.createDataFrame([(i, f"sig {i}") for i in "xyh"], "id string, signature string")
    found = RT.placed(spark.createDataFrame([("x", 1)], "id string, rank int"), edges, nodes)
    size = F.aggregate(F.map_values("context"), F.lit(0), lambda a, x: a + F.size(x))
    shown = {(r.id, r.kind, r.n) for r in RT.with_contexts(found, edges, nodes).select("id", "kind", size.alias("n")).collect()}
    assert shown == {(r.id, r.kind, r.related) for r in RT.with_related(found, edges, nodes).collect()} == {("x", "chunk", 1), ("h", "signature", 3)}


def test_a_hub_shows_all_its_names_in_parts(spark):
    names = [f"n{i:04}" for i in range(2500)]
    calls = [("h", n, "referenced_by") for n in names] + [("h", "n0001", "calls"), ("x", "h", "references")]
    edges = spark.createDataFrame(calls, "src string, dst string, edge_type string")
    nodes = spark.createDataFrame([(i, f"name {i}" if i != "n0007" else None, "") for i in ["x", "h", "alone", *names]], "id string, name string, signature string")
    hits = spark.createDataFrame([(q, i, r) for q in (1, 2) for r, i in enumerate(("x", "alone", None), 1)], "query int, id string, rank int")
    found = RT.retrieve(hits, edges, nodes)
    shown = {}
    for r in found.collect():
        shown.setdefault((r.query, r.id), []).append((r.part, r.context))
    assert {len(v) for v in shown.values()} == {1, 3} and set(shown) == {(q, i) for q in (1, 2) for i in ("x", "h", "alone", None)}
    for q in (1, 2):
        assert shown[q, "x"] == [(0, {"references": ["name h"]})] and shown[q, "alone"] == shown[q, None] == [(0, None)]
        parts = dict(shown[q, "h"])
        assert set(parts) == {0, 1, 2} and all(600 < len(c["referenced_by"]) < 1100 and c["referenced_by"] == sorted(c["referenced_by"]) for c in parts.values())
        assert sorted(n for c in parts.values() for n in c["referenced_by"]) == sorted("n0007" if n == "n0007" else f"name {n}" for n in names)
        assert [c["calls"] for c in parts.values() if "calls" in c] == [["name n0001"]]
    assert {(r.query, r.id): r.related for r in RT.related(found).collect()} == {(q, i): n for q in (1, 2) for i, n in (("x", 1), ("h", 2501), ("alone", 0), (None, 0))}
    assert {tuple(r) for r in RT.counts(found).collect()} == {(1, 3, 1), (2, 3, 1)}


def test_the_query_retrieve_brings_contexts(spark, monkeypatch):
    shown = []
    monkeypatch.setattr(G, "context_parts", functools.partial(G.context_parts, names=20))
    monkeypatch.setattr(RT, "with_contexts", lambda *a, make=RT.with_contexts: shown.append(make(*a)) or shown[-1])
    got = {(r.query, r.id): r.related for r in Q.QUERIES["retrieve"](spark, "/root/testdata/sf0.001").collect()}
    names = {}
    for r in shown[0].collect():
        names.setdefault((r.query, r.id), []).extend(n for v in (r.context or {}).values() for n in v)
    assert len(shown) == 1 and shown[0].where("part > 0").count() and got == {k: len(set(v)) for k, v in names.items()} and max(got.values()) > 2
    assert all(i.startswith(("source:", "lang:")) for (_, k), v in names.items() if k.startswith("doc:") for i in v)
    of_file = Q.QUERIES["retrieve_for_file"](spark, "/root/testdata/sf0.001").collect()
    assert shown[1].where("part > 0").count() and len(of_file) == len(set(of_file))


def test_retrieval_brings_documents_and_counters(spark):
    docs = spark.createDataFrame(KB, "id string, title string, topics array<string>, tags array<string>, full_content string, priority int")
    section = "cast(array(named_struct('heading', 'H', 'content', coalesce(full_content, ''), 'code_blocks', array())) as array<struct<heading:string,content:string,code_blocks:array<struct<language:string,code:string>>>>)"
    docs = docs.where("id <> 'c'").withColumn("summary", F.lit("s")).withColumn("sections", F.expr(section))
    chunks = spark.createDataFrame([("x", "loader reads"), ("y", "writer"), ("z", "nothing")], "id string, content string")
    edges = spark.createDataFrame([("x", "y", "calls")], "src string, dst string, edge_type string")
    nodes = spark.createDataFrame([("x", "sig x"), ("y", "sig y")], "id string, signature string")
    queries = spark.createDataFrame([(1, "loader"), (2, "yak"), (3, "qq")], "query int, text string")
    found = RT.search_code(chunks, edges, nodes, queries, docs=docs)
    assert {(r.query, r.id) for r in found.collect() if r.kind != "document"} == {(1, "x"), (1, "y")}
    got = {r.query: tuple(r)[1:] for r in RT.counters(found, queries).collect()}
    assert got == {1: (1, 1, 1, 1, 3), 2: (0, 0, 0, 0, 3), 3: (0, 0, 0, 0, 3)}
    laid = {r.query: r.context for r in RT.document_contexts(found, docs).collect()}
    for i, text in ((1, "loader"), (2, "yak"), (3, "qq")):
        assert laid[i] == RT.knowledge(docs, text).first()["context"]
