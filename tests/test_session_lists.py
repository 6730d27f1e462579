import pytest
from oracle import SF, expected, rows
from pyspark.sql import functions as F

from quarryline.functions import paths as P
from quarryline.operators import retrieve as RT
from quarryline.operators import sessions as S
from quarryline.plans import queries as Q
from quarryline.sources import markdown as MD

SESSION = "session string, project string, instruction string, status string, created_at string"


@pytest.mark.parametrize("name", ["listed_sessions", "session_hints", "run_summary", "shown_language"])
def test_queries_equal_sql(spark, name):
    cols, got = rows(Q.QUERIES[name](spark, SF))
    assert got == expected(Q.SQL[name], cols) and got


def test_lists_and_hints(spark):
    data = [
        ("a", "p", "x" * 46, "completed", "2024-03-05T23:30:00+05:30"), ("b", "p", "x" * 45, "thinking", "2024-03-05T23:30:00Z"), ("c", "p", None, None, None),
        ("d", "p", "y" * 41, "odd", "yesterday at noon"), ("e", None, "", "failed", ""), ("f", None, "z", "cancelled", "2024"), ("g", "q", "one", "running", "2024-12-31"),
    ]
    df = spark.createDataFrame(data, SESSION).withColumn("extra", F.lit(1))
    got = sorted((tuple(r) for r in S.listed_sessions(df).collect()), key=repr)
    assert got == sorted([
        ("p", 1, "d", "yesterday ", "y" * 41, "odd"), ("p", 2, "b", "Mar 05 23:30", "x" * 45, "◌ active"), ("p", 3, "a", "Mar 05 23:30", "x" * 45 + "...", "✓ done"), ("p", 4, "c", "Unknown", "", "unknown"),
        (None, 1, "f", "2024", "z", "⊘ cancel"), (None, 2, "e", "Unknown", "", "✗ failed"), ("q", 1, "g", "Dec 31 00:00", "one", "◌ active"),
    ], key=repr)
    assert sorted(map(tuple, S.session_hints(df).collect()), key=repr) == sorted([("p", 3, "y" * 40 + "..."), (None, 2, "z"), ("q", 1, "one")], key=repr)
    assert S.listed_sessions(df.where("false")).collect() == [] and S.listed_sessions(df, 1).count() == 3


def test_summary_counts_since_the_last_phase(spark):
    events = [
        ("s", 1, "phase_start", "1"), ("s", 2, "milestone", "a"), ("s", 3, "change", "f"), ("s", 4, "phase_start", "2"), ("s", 5, "milestone", "b"), ("s", 6, "milestone", "b"),
        ("s", 7, "change", "f"), ("s", 8, "change", ""), ("s", 9, "error", "x"), ("s", 10, "error", "y"), ("s", 11, "error", None), ("t", 1, "milestone", "a"), ("t", 2, "other", "z"), (None, 1, "milestone", "m"), (None, 2, "phase_start", "odd"), ("u", 1, "other", "z"),
    ]
    df = spark.createDataFrame(events, "session string, seq int, type string, value string")
    got = {tuple(r) for r in S.run_summary(df, "session", ["seq"]).collect()}
    assert got == {("s", 1, 2, 1, "y"), ("t", 0, 0, 1, None), (None, 0, 0, 0, None)}
    assert S.run_summary(df.where("false"), "session", ["seq"]).collect() == []


def test_sessions_of_a_project_and_events_of_a_session(spark):
    df = spark.createDataFrame([("a", "p", "", "", "1"), ("b", "p", "", "", "2"), ("c", "q", "", "", "3"), ("d", "p", "", "", "2"), ("e", None, "", "", "9")], SESSION)
    assert [r.session for r in S.project_sessions(df, "p").collect()] == ["b", "d", "a"] and [r.session for r in S.project_sessions(df, "p", 1).collect()] == ["b"]
    events = spark.createDataFrame([("s", 3), ("s", 1), ("t", 2), (None, 0), ("s", 2)], "session string, seq int")
    assert [r.seq for r in S.session_events(events, "session", "s", ["seq"], 2).collect()] == [1, 2] and S.session_events(events, "session", "none", ["seq"]).collect() == []
    assert [r.seq for r in RT.by_id(events, "t", "session").collect()] == [2] and RT.by_id(events, "x", "session").collect() == []


def test_names_of_languages(spark):
    paths = ["a/b.KT", "x.php", "y.h", "noext", "z.swift", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.l for r in df.select(P.language(F.col("path"), P.SHOWN_LANGUAGES).alias("l")).collect()] == ["kotlin", "text", "c", "text", "swift", "text"]


def test_unchanged_documents_are_taken_over(spark):
    files = lambda *rows: spark.createDataFrame(rows, "path string, content string")
    first = MD.refreshed(files(("a.md", "# A\nx"), ("b.md", "# B\ny"), ("c.md", None)))
    marked = spark.createDataFrame(first.withColumn("title", F.lit("earlier")).collect(), first.schema)
    now = {r.path: r for r in MD.refreshed(files(("a.md", "# A\nx"), ("b.md", "# B\nz"), ("d.md", "")), marked).collect()}
    assert {p: r.title for p, r in now.items()} == {"a.md": "earlier", "b.md": "", "d.md": ""}
    assert now["b.md"].sections[0].content == "z" and len(now["a.md"].hash) == 12
