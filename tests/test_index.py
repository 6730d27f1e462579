"""Pairing in time, the segmented index and search over it, names in order of insertion."""

import datetime as dt
import glob
import os
import random

from pyspark.sql import functions as F

from quarryline.operators import events as E
from quarryline.operators import files as FI
from quarryline.operators import graph as G
from quarryline.operators import postings as P
from quarryline.operators import ranking as R
from quarryline.operators import retrieve as RT
from quarryline.operators import store
from quarryline.functions import output as O
from quarryline.streaming import pairing

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def by_rule(events):
    """Calls with their ends by walking through the events as they come: {call: (end, success)}."""
    running, out = {}, {}
    for key, when, kind, name, ok in sorted(events, key=lambda e: (e[1], e[2] == "end")):
        if kind == "call":
            running[key] = name
            out[name] = None
        elif key in running:
            out[running.pop(key)] = (when, ok)
    return out


def test_an_end_closes_the_latest_open_call_before_it(spark):
    calls = [("s", "a", 1, "one"), ("s", "a", 3, "two"), ("s", "b", 1, "three"), ("s", "b", 2, "four"), ("s", "c", 5, "five"), ("s", None, 1, "six"), ("t", "a", 1, "seven")]
    ends = [("s", "a", 2, True), ("s", "b", 4, False), ("s", "b", 5, True), ("s", "c", 4, True), ("s", None, 2, None)]
    c = spark.createDataFrame([(s, i, at(x), n) for s, i, x, n in calls], "s string, id string, at timestamp, name string")
    e = spark.createDataFrame([(s, i, at(x), ok) for s, i, x, ok in ends], "s string, id string, at timestamp, success boolean")
    got = {r.name: (r.seconds, r.success) for r in E.pair_calls(c, e, ["s", "id"]).collect()}
    assert got == {"one": (1.0, True), "two": (None, None), "three": (None, None), "four": (2.0, False), "five": (None, None), "six": (1.0, None), "seven": (None, None)}
    assert {r.name for r in E.open_calls(E.pair_calls(c, e, ["s", "id"])).collect()} == {"two", "three", "five", "seven"}
    assert E.pair_calls(c.where("false"), e, ["s", "id"]).count() == 0 and E.pair_calls(c, e.where("false"), ["s", "id"]).where("done_at is not null").count() == 0


def test_changed_files(spark):
    rows = [("s", "write_file", "a", True), ("s", "edit_file", "a", True), ("s", "edit_file", "b", False), ("s", "read_file", "c", True), ("s", "write_file", "", True), ("t", "write_file", "d", None)]
    got = E.changed_files(spark.createDataFrame(rows, "session string, tool string, path string, success boolean"), "session")
    assert [tuple(r) for r in got.collect()] == [("s", "a")]


def random_events(rng, n, ids=5):
    return [(f"i{rng.randrange(ids)}", at(x), rng.choice(["call", "end"]), f"n{k}", rng.choice([True, False])) for k, x in enumerate(rng.sample(range(10 * n), n))]


def test_random_pairs_equal_the_rule(spark):
    events = random_events(random.Random(1), 300)
    df = spark.createDataFrame(events, "id string, at timestamp, kind string, name string, success boolean")
    got = {r.name: r.done_at and (r.done_at, r.success) for r in E.pair_calls(df.where("kind = 'call'").select("id", "at", "name"), df.where("kind = 'end'").select("id", "at", "success"), ["id"]).collect()}
    assert got == by_rule(events)


def test_the_stream_pairs_as_the_batch_does(spark, tmp_path):
    rng = random.Random(2)
    events = random_events(rng, 240)
    schema = "call_id string, at timestamp, kind string, tool string, success boolean"
    ordered = sorted(events, key=lambda e: e[1])
    part = [min(5, max(0, (i + rng.randrange(-15, 15)) // 40)) for i in range(240)]  # rows come up to 150 seconds out of order
    for k in range(6):
        spark.createDataFrame([(i, a, kind, n, ok) for (i, a, kind, n, ok), own in zip(ordered, part) if own == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
    files = sorted(glob.glob(str(tmp_path / "all" / "*.parquet")), key=os.path.getmtime)
    (tmp_path / "in").mkdir()
    stream = pairing.paired_calls(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "20 minutes", "10 days")
    run = stream.writeStream.format("memory").queryName("paired").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        last = spark.createDataFrame([("end of stream", at(40 * 86400), "end", "none", True)], schema)
        last.coalesce(1).write.parquet(str(tmp_path / "last"))
        for i, f in enumerate([*files, *glob.glob(str(tmp_path / "last" / "*.parquet"))]):
            os.link(f, tmp_path / "in" / f"{i:03d}.parquet")
            run.processAllAvailable()
    finally:
        run.stop()
    got = {}
    for r in spark.table("paired").collect():
        assert r.tool not in got
        got[r.tool] = r.done_at and (r.done_at, r.success)
    assert got == by_rule(events)


def test_settled_calls_of_the_fold():
    events = [[10, 0, "a", None], [30, 1, None, True], [20, 0, "b", None], [99, 1, None, False]]
    pending, running, settled = pairing.fold(events, None, 50, 1000)
    assert (pending, running) == ([[99, 1, None, False]], None) and [(c[2], e and e[0]) for c, e in settled] == [("a", None), ("b", 30)]
    assert pairing.fold([], [0, 0, "a", None], 2000, 1000) == ([], None, [([0, 0, "a", None], None)])


# --- the index


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def folder_bytes(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet"))


def same_index(spark, one, two):
    a, b = store.load(spark, one), store.load(spark, two)
    for part in store.PARTS:
        cols = sorted(a[part].columns)
        assert cols == sorted(b[part].columns)
        assert sorted(map(str, a[part].select(cols).collect())) == sorted(map(str, b[part].select(cols).collect())), part
    counts = [sorted(map(tuple, store.term_counts(spark, r)[0].collect())) + [tuple(store.term_counts(spark, r)[1].first())] for r in (one, two)]
    assert counts[0] == counts[1]


def test_updates_equal_a_rebuild_and_write_what_changed(spark, tmp_path):
    body = lambda i: f"def f{i}():\n    return g{i}(alpha, beta{i})\n" + "".join(f"\ndef h{i}_{k}():\n    return word{k}\n" for k in range(40))
    first = [(f"m{i}.py", body(i)) for i in range(20)]
    root, other = str(tmp_path / "u"), str(tmp_path / "b")
    store.build(frame(spark, first), root)
    whole = folder_bytes(root)
    second = [*first[1:], ("m1.py", "def f2():\n    return gone\n"), ("new.txt", "new words")]
    second = list(dict(second).items())
    changes = store.update(frame(spark, second), root, most=3)
    assert {tuple(r) for r in changes.collect()} == {("m0.py", "deleted"), ("m1.py", "modified"), ("new.txt", "new")}
    assert folder_bytes(root) - whole < 0.5 * whole and len(store.segments(spark, root)) == 2
    store.build(frame(spark, second), other)
    same_index(spark, root, other)
    assert store.update(frame(spark, second), root).count() == 0 and len(store.segments(spark, root)) == 2
    third = [*second[:-1], ("m0.py", body(0))]
    store.update(frame(spark, third), root, most=3)
    assert len(store.segments(spark, root)) == 3
    store.update(frame(spark, third[:5]), root, most=3)  # a fourth segment: compacted
    assert len(store.segments(spark, root)) == 1 and store.vacuum(spark, root) == 4 and store.vacuum(spark, root) == 0
    store.build(frame(spark, third[:5]), other)
    same_index(spark, root, other)
    assert store.is_ready(spark, root) and not store.is_ready(spark, str(tmp_path / "none"))
    store.update(frame(spark, []), root)
    assert not store.is_ready(spark, root)


def test_search_reads_its_terms_only(spark, tmp_path):
    rng = random.Random(3)
    words = [f"term{i}" for i in range(400)]
    files = [(f"d{i}.txt", " ".join(rng.choices(words, k=60))) for i in range(80)]
    root = str(tmp_path / "s")
    store.build(frame(spark, files), root)
    files = files[10:] + [("d3.txt", "term1 term2 fresh")]
    store.update(frame(spark, files), root)
    asked = spark.createDataFrame([("a", "term7 TERM9 term7"), ("b", "fresh"), ("c", "the unknown")], "query string, text string")
    chunks = store.searchable(store.load(spark, root)["chunks"])
    want = [tuple(r) for r in RT.search(chunks, asked).orderBy("query", "rank").collect()]
    got = RT.search(chunks, asked, index=root)
    assert [tuple(r) for r in got.orderBy("query", "rank").collect()] == want and [r[1] for r in want if r[0] == "b"] == ["d3.txt:module"] and not [r for r in want if r[0] == "c"]
    plan = store.scores(spark, root, asked)._jdf.queryExecution().toString()
    buckets = {r[0] for r in asked.select(F.explode(F.split(F.lower("text"), " ")).alias("t")).where("t not in ('the')").select(store.P.bucket_of(F.col("t"))).distinct().collect()}
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan and len(buckets) < 8
    name = store.segments(spark, root)[0][1]
    read = store.P.for_terms(spark, [f"{root}/segments/{name}/postings"], store.R.query_terms(asked, "query", "text"), "id string, term string, dl int, tf long, file string")
    files_read = read.select(F.input_file_name().alias("f")).distinct().collect()
    assert files_read and {int(r.f.split("bucket=")[1].split("/")[0]) for r in files_read} <= buckets


# --- names


def chunk_rows():
    return [
        ("a.py:f", "a.py", "function", "f", None, ["g", "f", "late"], [], 1), ("a.py:g", "a.py", "function", "g", None, ["f"], [], 5), ("a.py:C.m", "a.py", "method", "m", "C", [], [], 8), ("a.py:C", "a.py", "class", "C", None, [], ["Base"], 9),
        ("b.py:Base", "b.py", "class", "Base", None, [], [], 1), ("b.py:D", "b.py", "class", "D", None, [], ["C", "Base"], 2), ("b.py:D.n", "b.py", "method", "n", "D", ["g", "late"], [], 3), ("b.py:late", "b.py", "function", "late", None, ["n"], [], 9),
    ]


def test_edges_in_order_of_insertion(spark):
    chunks = spark.createDataFrame(chunk_rows(), "id string, file string, type string, name string, parent string, calls array<string>, imports array<string>, line_start int")
    forward = lambda df: {(r.src, r.edge_type, r.dst) for r in df.where(F.col("edge_type").isin(*G.INVERSE)).collect()}
    always = {("a.py:f", "calls", "a.py:f"), ("a.py:g", "calls", "a.py:f"), ("b.py:D", "inherits", "a.py:C"), ("b.py:D", "inherits", "b.py:Base"), ("b.py:D.n", "calls", "a.py:g"), ("b.py:late", "calls", "b.py:D.n"), ("b.py:D", "defines", "b.py:D.n")}
    assert forward(G.edges(chunks, ordered=True)) == always
    later = {("a.py:f", "calls", "a.py:g"), ("a.py:f", "calls", "b.py:late"), ("a.py:C", "inherits", "b.py:Base"), ("b.py:D.n", "calls", "b.py:late"), ("a.py:C", "defines", "a.py:C.m")}
    assert forward(G.edges(chunks)) == always | later


def test_names_of_one_file_meet_no_others(spark):
    calls = spark.range(400).selectExpr("concat('c', id) as src", "concat('f', id % 50) as file", "id as seq", "'f' as name")
    symbols = spark.range(50).selectExpr("concat('s', id) as id", "concat('f', id) as file", "id as seq", "'f' as name")
    assert {(r.src, r.dst) for r in G.resolve(calls, symbols, ordered=False).collect()} == {(f"c{i}", f"s{i % 50}") for i in range(400)}


# --- white space


def test_lines_lose_all_white_space(spark):
    d = spark.createDataFrame([("k", "\tif the thing\t\r\nno\n the\xa0end ")], "key string, text string")
    assert [r.content for r in FI.grep(d, "key", "text", "the").collect()] == ["if the thing", "the\xa0end"]
    assert [x.content for x in d.select(FI.matches(F.col("text"), "the").alias("m")).first().m] == ["if the thing", "the\xa0end"]
    o = spark.createDataFrame([("x\n\t\t\n  \ny",)], "o string")
    assert tuple(o.select(O.shell_output(F.col("o"), F.lit("ls"), F.lit(True)).alias("x")).first().x)[:4] == ("x\ny", "default", 4, 2)


def test_postings_are_dealt_once_and_same_keys_add_up(spark, tmp_path):
    text = "alpha beta alpha gamma\nbeta alpha"
    twice = "class A:\n    def size():\n        return alpha + alpha + beta\n\n    def size():\n        return alpha + gamma + beta\n\n    def size():\n        return alpha\n"
    files = [("a.txt", text), ("none.txt", "of a to"), ("c.py", twice), *((f"f{i}.txt", f"alpha own{i} 12345 ÄÖÜ") for i in range(40))]
    root = str(tmp_path / "p")
    store.build(frame(spark, files), root)
    chunks, posted = (store.load(spark, root)[x] for x in ("chunks", "postings"))
    # As counted by joining and grouping: rows with the same id and dl add up.
    want = R.postings(store.searchable(chunks), "id", "content").join(chunks.select("id", "file").distinct(), "id")
    cols = ["id", "file", "term", "dl", "tf"]
    assert sorted(map(tuple, posted.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    got = {(r.id, r.term): r.tf for r in posted.collect()}
    assert got["a.txt:module", "alpha"] == 3 and got["f7.txt:module", "äöü"] == 1 and not [k for k in got if k[0].startswith("none")]
    df = {r.term: r.df for r in posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    store.update(frame(spark, files[:2]), root)  # what is gone is taken off just as it was added
    left = {r.term: r.df for r in store.term_counts(spark, root)[0].collect()}
    assert left == {"alpha": 1, "beta": 1, "gamma": 1} and df["alpha"] > 40
    assert "Exchange" not in P.counted(frame(spark, files), ["path"], "content")._jdf.queryExecution().executedPlan().toString()
