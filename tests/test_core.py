import pytest
from oracle import SF, expected, rows

from quarryline.functions import text as T
from quarryline.operators import events, graph, index, ranking
from quarryline.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, name):
    cols, got = rows(Q.QUERIES[name](spark, SF))
    assert got == expected(Q.SQL[name], cols)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_bm25_finds_the_rare_term(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma delta"), (3, "alpha omega"), (4, None)], "id long, text string")
    q = spark.createDataFrame([(0, "find the gamma")], "q long, text string")
    got = ranking.top(ranking.scores(docs, q, "id", "text", "q", "text"), "id").collect()
    assert [r["id"] for r in got] == [2] and got[0]["score"] > 0


def test_resolve_prefers_the_same_file_and_earlier_symbols(spark):
    symbols = spark.createDataFrame([("a:f", "a", 1, "f"), ("b:f", "b", 2, "f"), ("c:g", "c", 9, "g")], "id string, file string, seq int, name string")
    calls = spark.createDataFrame([("a:x", "a", 5, "f"), ("z:x", "z", 5, "f"), ("z:x", "z", 5, "g")], "src string, file string, seq int, name string")
    assert {(r.src, r.dst) for r in graph.resolve(calls, symbols).collect()} == {("a:x", "a:f"), ("z:x", "a:f"), ("z:x", "b:f")}
    assert ("z:x", "c:g") in {(r.src, r.dst) for r in graph.resolve(calls, symbols, ordered=False).collect()}


def test_hops_grow_and_leave_out_the_start(spark):
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("c", "d", "calls")], "src string, dst string, edge_type string")
    start = spark.createDataFrame([("a",)], "id string")
    one, three = ({r.id: r.hop for r in graph.neighbors(e, start, n).collect()} for n in (1, 3))
    assert one == {"b": 1} and three == {"b": 1, "c": 2, "d": 3}


def test_update_equals_rebuild(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    ch = index.detect_changes(old, new)
    assert {(r.path, r.change) for r in ch.collect()} == {("b", "modified"), ("c", "deleted"), ("d", "new")}
    merged = index.merge(old, new.join(ch.where("change <> 'deleted'"), "path", "left_semi"), ch.where("change = 'deleted'"), "path")
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in new.collect()}


def test_sse_records(spark):
    lines = ["event: a", "data: 1", "data: 2", "", "event: b", "", "data: x", "", "event: c", "data: end"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream string, seq long, line string")
    assert {(r.event, r.data) for r in events.framed(df, "stream", "seq", "line").collect()} == {("a", "1\n2"), ("c", "end")}


def test_text_expressions(spark):
    df = spark.createDataFrame([("fooBar_baz the_x Import42",)], "t string")
    assert df.select(T.tokens(df.t)).first()[0] == ["foobar", "baz", "the", "import42"]
    assert df.select(T.query_tokens(df.t)).first()[0] == ["foobar", "baz", "import42"]
