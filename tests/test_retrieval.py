"""Graph building, retrieval, search, output and edits on small fixtures with results written out."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import output as O
from quarryline.functions import text as T
from quarryline.operators import files as FI
from quarryline.operators import graph as G
from quarryline.operators import retrieve as RT
from quarryline.operators import store
from quarryline.sources import code, outline

FILES = [
    ("a.py", "import os\nfrom m import x\nimport y as z\n\nclass Base:\n    pass\n\nclass A(Base):\n    def go(self):\n        return helper()\n\ndef helper():\n    return other()\n"),
    ("b.py", "def helper():\n    pass\n\ndef other():\n    return helper()\n"),
    ("q.sql", "CREATE TABLE t (a int);\nCREATE VIEW v AS SELECT * FROM t;"),
]


@pytest.fixture(scope="module")
def graph(spark):
    chunks = code.chunk_files(spark.createDataFrame(FILES, "path string, content string")).cache()
    return chunks, G.edges(chunks).cache(), G.nodes(chunks).cache()


def test_graph_of_chunks(graph):
    chunks, edges, nodes = graph
    got = {tuple(r) for r in edges.select("src", "edge_type", "dst").collect()}
    forward = {
        ("a.py:A.go", "calls", "a.py:helper"), ("a.py:helper", "calls", "b.py:other"), ("b.py:other", "calls", "b.py:helper"),  # its own file's first
        ("a.py:A", "inherits", "a.py:Base"), ("a.py:A", "defines", "a.py:A.go"), ("q.sql:view:v", "references", "q.sql:table:t"),
    }
    back = {(d, G.INVERSE[e], s) for s, e, d in forward}
    assert got == forward | back | {("a.py:module", "imports", "os"), ("a.py:module", "imports", "m")}
    assert {r.id for r in nodes.collect()} == {r.id for r in chunks.collect()}


def test_expansion_by_type_and_existing_nodes(spark, graph):
    _, edges, nodes = graph
    start = spark.createDataFrame([("a.py:A.go",)], "id string")
    got = {(r.id, r.hop) for r in G.neighbors(edges, start, 2).collect()}
    assert got == {("a.py:helper", 1), ("a.py:A", 1), ("b.py:other", 2), ("a.py:Base", 2)}
    assert {r.id for r in G.neighbors(edges, start, 2, ["calls"]).collect()} == {"a.py:helper", "b.py:other"}
    few = nodes.where("id <> 'a.py:helper'")
    assert {r.id for r in G.neighbors(edges, start, 2, known=few).collect()} == {"a.py:A", "a.py:Base"}
    assert {r.id for r in G.remove_prefix(edges, "q.sql:").select(F.col("src").alias("id")).collect()} & {"q.sql:view:v"} == set()


def test_signatures_come_hit_by_hit(spark, graph):
    _, edges, nodes = graph
    hits = spark.createDataFrame([("q", "b.py:other", 1), ("q", "a.py:A.go", 2)], "query string, id string, rank int")
    got = RT.retrieve(hits, edges, nodes, hops=2, max_signatures=3).orderBy("kind", "position").collect()
    assert [(r.id, r.kind) for r in got] == [("b.py:other", "chunk"), ("a.py:A.go", "chunk"), ("a.py:helper", "signature"), ("b.py:helper", "signature"), ("a.py:A", "signature")]
    assert got[0].context == {"calls": ["helper"], "called_by": ["helper"]} and got[2].signature == "def helper():"
    assert tuple(RT.counts(RT.retrieve(hits, edges, nodes, 0)).first()) == ("q", 2, 0)


def test_symbols_and_files(spark, graph):
    chunks, edges, nodes = graph
    own = store.searchable(chunks)
    asked = spark.createDataFrame([("s", "OTHER")], "query string, text string")
    assert [r.id for r in RT.retrieve_symbol(own, edges, nodes, asked).where("kind = 'chunk'").collect()] == ["b.py:other"]
    got = RT.retrieve_for_file(own, edges, nodes, "b.py").orderBy("kind", "position").collect()
    assert [(r.id, r.kind) for r in got] == [("b.py:helper", "chunk"), ("b.py:other", "chunk"), ("a.py:helper", "signature")]
    got = RT.search_code(own, edges, nodes, asked, hops=9, k=99).collect()
    assert {r.id for r in got if r.kind == "chunk"} == {"b.py:other", "a.py:helper"} and {r.id for r in got if r.kind != "chunk"} == {"b.py:helper", "a.py:A.go", "a.py:A"}


def test_search_of_files(spark):
    f = spark.createDataFrame([("a.py", "bar\nfoo here\n.*"), (".b.py", "foo"), ("c.bin", "foo"), ("d.py", "x" * 2_000_000 + "\nfoo"), ("dist/e.py", "foo")], "path string, content string")
    got = FI.search_files(f, "^foo").collect()
    assert [(r.path, r.line, r.content, r.context) for r in got] == [("a.py", 2, "foo here", "bar\nfoo here\n.*"), ("c.bin", 1, "foo", "foo"), ("dist/e.py", 1, "foo", "foo")]
    assert [r.line for r in FI.search_files(f, "bar$", "*.py").collect()] == [1] and FI.search_files(f, "O", most=1).count() == 1
    with pytest.raises(ValueError):
        FI.search_files(f, "(")
    assert [(r.path, r.line) for r in FI.search_project(f, "^foo").collect()] == [(".b.py", 1), ("a.py", 2), ("d.py", 2)]
    assert [r.content for r in FI.search_project(f, ".*[").collect()] == [] and [r.path for r in FI.search_project(f, "foo", root="none").collect()] == [".b.py", "a.py", "d.py"]


def test_edits_and_output(spark):
    d = spark.createDataFrame([("one one", "one", "two"), ("one", " x ", "x"), ("one", "q", "r"), (None, "a", "b")], "t string, s string, n string")
    got = [tuple(r.e) for r in d.select(T.edited(F.col("t"), F.col("s"), F.col("n"), every=True).alias("e")).collect()]
    assert got == [("two two", 2, None), ("one", 0, "Edit changes nothing"), ("one", 0, "Search text not found"), (None, 0, "File not found")]
    assert d.select(T.edited(F.col("t"), F.col("s"), F.col("n")).alias("e")).first().e.content == "two one"
    assert [r[0] for r in d.select(T.occurrences(F.col("t"), "")).collect()] == [8, 4, 4, None]
    o = spark.createDataFrame([("pip install x", "Collecting a\n\nUsing cached ERROR b\r\nok\n"), ("ls", "y" * 100 + "\n" + "z" * 3000), ("pytest", None)], "c string, o string")
    got = [r.x for r in o.select(O.shell_output(F.col("o"), F.col("c"), F.lit(True)).alias("x")).collect()]
    assert tuple(got[0]) == ("Using cached ERROR b\nok", "install", 4, 2, False, 500)
    assert got[1].truncated and got[1].output.endswith("z\n... (truncated)") and tuple(got[2])[:4] == ("", "test", 0, 0)
    r = spark.range(1).select(O.tool_result(F.lit("nope"), ["read"], F.lit("r"), F.lit(None).cast("string")).alias("a"), O.tool_result(F.lit("read"), ["read"], F.lit("r"), F.lit(None).cast("string")).alias("b")).first()
    assert tuple(r.a) == (None, "Unknown tool: nope") and tuple(r.b) == ("r", None)


def test_arrow_functions_end_with_their_body():
    got = {r["name"]: r["content"] for r in code.script_chunks("s.js", "const f = x => x+1;\nfunction g(){ return {a: 1} }\nconst h = (a) =>\n  run(a,\n    1)\nconst k = async () => { go() }\nfoo(const_ => 1)")}
    assert got == {"f": "const f = x => x+1", "g": "function g(){ return {a: 1} }", "h": "const h = (a) =>\n  run(a,\n    1)", "k": "const k = async () => { go() }"}


def test_symbols_by_pattern(spark):
    text = "class A:\n    def m(self,\n          x):\n        pass\n\ndef f(a):\n    pass\ndef g():\n    pass\n# def no(\n"
    got = outline.pattern_symbols(spark.createDataFrame([("p", text), ("q", None)], "path string, content string")).collect()
    assert sorted((r.line, r.name, r.kind, r.signature) for r in got) == [(1, "A", "class", ""), (2, "m", "method", "(self,\n          x)"), (5, "f", "method", "(a)"), (8, "g", "function", "()")]
