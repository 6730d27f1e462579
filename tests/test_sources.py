from oracle import SF

from quarryline.operators.retrieve import retrieve
from quarryline.sources import code, markdown, outline
from quarryline.streaming import events as S

PY = '''import os
@deco
def f(x):
    return g(os.path.join(x))

class A(Base):
    """Doc."""
    async def m(self):
        return "é"
    class B:
        def n(self): pass
'''


def test_chunks(spark):
    files = [("a.py", PY), ("bad.py", "def ("), ("big.py", "x" * 200_000), ("q.sql", "CREATE TABLE t (a int);\nCREATE VIEW v AS SELECT * FROM t;"), ("s.js", "function go(a) { run(a); }\nconst k = (x) => { return x };\nclass C { }"), ("n.txt", None)]
    got = {r.id: r for r in code.chunk_files(spark.createDataFrame(files, "path string, content string")).collect()}
    assert {"a.py:f", "a.py:A", "a.py:A.m", "a.py:B", "a.py:B.n", "a.py:module", "bad.py:module", "q.sql:table:t", "q.sql:view:v", "s.js:go", "s.js:k", "s.js:C"} == set(got)
    assert got["a.py:f"].calls == ["g", "join"] and got["a.py:A"].imports == ["Base"] and got["q.sql:view:v"].imports == ["t"]
    assert got["s.js:go"].content == "function go(a) { run(a); }" and "é" in got["a.py:A.m"].content


def test_sections(spark):
    text = "---\ntags: [A, b]\npriority: high\n---\nlost\n# One\ntext\n```py\n# no heading\n```\n## Two\nmore"
    got = markdown.sections(spark.createDataFrame([("d.md", text), ("e.md", None)], "path string, content string")).collect()
    assert [(r.heading, r.level, r.content, r.code_blocks, r.priority, r.tags) for r in got] == [("One", 1, "text", ["# no heading"], 80, ["a", "b"]), ("Two", 2, "more", [], 80, ["a", "b"])]


def test_retrieve(spark):
    hits = spark.createDataFrame([("a", 1)], "id string, rank int")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "x", "calls"), ("b", "c", "calls")], "src string, dst string, edge_type string")
    nodes = spark.createDataFrame([(i, "sig " + i) for i in "abc"], "id string, signature string")
    assert {(r.id, r.kind, r.position) for r in retrieve(hits, edges, nodes, 2).collect()} == {("a", "chunk", 1), ("b", "signature", 1), ("c", "signature", 2)}


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.event_stream(spark, str(tmp_path / "in"), batch.schema)
    q = S.latest(stream, ["user_id", "event_type"], ["ts", "event_id"], "event_id").writeStream.format("memory").queryName("latest_events").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = S.latest(batch, ["user_id", "event_type"], ["ts", "event_id"], "event_id").collect()
    assert sorted(spark.table("latest_events").collect()) == sorted(want)


def test_outlines(spark):
    tree = "root/\n├── src/\n│   ├── a b.py\n│   └── sub/\n│       └── c.py\n└── d.md\n"
    rows = [(1, tree), (2, '{"x": {"y.py": null, "z": {}}, "w.md": 1}'), (3, None), (4, "{bad")]
    got = outline.outline_paths(spark.createDataFrame(rows, "id int, text string")).orderBy("id", "position").collect()
    assert [(r.id, r.path) for r in got] == [("1", "src/ab.py"), ("1", "src/sub/c.py"), ("1", "d.md"), ("2", "x/y.py"), ("2", "w.md")]


def test_symbols_by_pattern(spark):
    files = [("a.py", "class A:\n    def m(self):\n        pass\ndef f(x, y):\n    pass\n\ndef g(): pass\n"), ("b.py", None)]
    got = outline.pattern_symbols(spark.createDataFrame(files, "path string, content string")).collect()
    assert [(r.name, r.kind, r.line, r.signature) for r in got] == [("A", "class", 1, ""), ("m", "method", 2, "(self)"), ("f", "function", 4, "(x, y)"), ("g", "method", 6, "()")]
