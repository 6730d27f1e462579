import difflib

from pyspark.sql import functions as F

from quarryline.functions import paths as P
from quarryline.functions import records as RC
from quarryline.operators import files as FI
from quarryline.operators import project as PR
from quarryline.operators import sessions as S
from quarryline.operators import store
from quarryline.sources import tree

PATHS = ["a.py", "src/b.PY", "node_modules/x.js", "dist/y.py", "lib/z.min.js", ".env", "Dockerfile", "yarn.lock", "package.json", "README.md", "deep/.hidden.py", "noext", ".gitignore"]


def frame(spark, rows=None):
    return spark.createDataFrame(rows or [(p, "x\ny\n") for p in PATHS], "path string, content string")


def paths(df):
    return {r.path for r in df.collect()}


def test_scans(spark):
    f = frame(spark)
    assert paths(PR.project_scan(f)) == {"a.py", "src/b.PY", "README.md", "deep/.hidden.py"} | {"package.json"}
    assert paths(PR.context_scan(f)) == set(PATHS) - {"node_modules/x.js", "dist/y.py", ".env"}
    assert [tuple(r) for r in PR.listing(f, "*.py", limit=2).collect()] == [("a.py", True), ("dist/y.py", True)]
    assert paths(PR.root_config(f)) == {"package.json"}
    assert paths(f.where(P.ignored_substring(F.col("path"), ["dist", "*.lock"]))) == {"dist/y.py", "yarn.lock"}
    assert PR.stat(spark.createDataFrame([("a.py",), ("q",)], "path string"), f).orderBy("path").collect() == [("a.py", True, 4), ("q", False, None)]


def test_path_parts(spark):
    df = spark.createDataFrame([("a/b.tar.gz",), (".bashrc",), ("x/Makefile",), ("y.PY",)], "p string")
    got = df.select(P.name(df.p), P.suffix(df.p), P.stem(df.p), P.language(df.p)).collect()
    assert [tuple(r) for r in got] == [("b.tar.gz", ".gz", "b.tar", "text"), (".bashrc", "", ".bashrc", "text"), ("Makefile", "", "Makefile", "text"), ("y.PY", ".PY", "y", "python")]


def test_resolved_paths_stay_below_the_root(spark):
    df = spark.createDataFrame([("a/../b",), ("./a//b/.",), ("../x",), ("a/../../x/y",), ("/etc",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(P.resolved(df.p)).collect()] == ["b", "a/b", None, None, None, "", None]


def test_bounded_reads_and_counts(spark):
    f = frame(spark, [("a.py", "1\n2\n3"), ("b.py", "1\n2\n"), ("c.bin", "1"), ("d.py", "é" * 60_000), ("e.py", None)])
    assert sorted(map(tuple, PR.bounded_read(f, 2).collect())) == [("a.py", "1\n2\n... (truncated)", 2), ("b.py", "1\n2\n", 2), ("e.py", "", 0)]
    assert sorted(map(tuple, PR.write_counts(f.where("path <> 'd.py'")).collect())) == [("a.py", 3, 5), ("b.py", 2, 4), ("c.bin", 1, 1), ("e.py", 0, 0)]
    assert tuple(PR.write_summary(f).first()) == (4, 1, 7, 120_010, True)


def test_collected_files_pass_over_large_ones(spark):
    f = frame(spark, [("big.py", "x" * 60), ("src/x.py", "y" * 30), ("app.py", "z" * 30), ("package.json", "w" * 30), ("other.py", "o")])
    got = PR.collect_files(f, "Fix big.py and src/x.py", max_chars=70).collect()
    assert [(r.position, r.path) for r in got] == [(0, "big.py")]
    got = PR.collect_files(f, "Fix src/x.py", max_chars=65).collect()
    assert [(r.position, r.path) for r in got] == [(0, "src/x.py"), (1, "package.json")]
    assert PR.collect_files(f.where("false"), "x").count() == 0


def test_changes_apply_in_order(spark):
    f = frame(spark, [("a", "one one"), ("b", "x"), ("c", "keep")])
    ch = [(2, "edit", "a", None, "two", "three"), (1, "edit", "a", None, "one", "two"), (3, "edit", "a", None, "nope", "x"), (1, "delete", "b", None, None, None), (2, "edit", "b", None, "x", "y"), (1, "create", "n", "new", None, None), (2, "edit", "n", None, "", ">"), (1, "edit", "m", None, "q", "r")]
    got = PR.apply_changes(f, spark.createDataFrame(ch, "seq int, type string, path string, content string, search string, replace string"))
    assert sorted(map(tuple, got.collect())) == [("a", "three one", 2, 1), ("b", None, 1, 1), ("c", "keep", 0, 0), ("m", None, 0, 1), ("n", ">new", 2, 0)]


def test_diff(spark):
    old, new = "a\nb\nc\n", "a\nB\nc\n"
    got = PR.unified_diff(spark.createDataFrame([("f", old, new), ("g", None, "")], "path string, old string, new string")).collect()
    assert {r.path: r.diff for r in got} == {"f": "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), "a/f", "b/f")), "g": ""}


def test_records(spark):
    raw = ['{"text": {"message": "m"}}', '{"payload": {"message": "p"}, "message": "q"}', '{"content": "c"}', '{"human_readable_summary": "s", "text": "t"}', "plain", '{"other": 1}']
    df = spark.createDataFrame([(x,) for x in raw], "r string")
    assert [r[0] for r in df.select(RC.readable(df.r)).collect()] == ["m", "p", "c", "s", "plain", '{"other": 1}']
    assert tuple(df.select(RC.change(F.lit('{"path": "a", "search": "b"}')).alias("c")).first().c) == ("", "a", None, "b", None, "")
    said = spark.createDataFrame([("[w] go",), ("[w] Using x",), ("[w] Step 1",), ("free",)], "t string")
    assert [tuple(r) for r in said.select(RC.worker(said.t), RC.action(said.t)).collect()] == [("w", "go"), ("w", None), ("w", None), ("", "free")]


def test_phases(spark):
    e = [("s", 1, "plan", "one\ntwo\nthree", None, None), ("s", 2, "worker_start", None, None, None), ("s", 3, "tool", None, None, None), ("s", 4, "worker_done", None, None, None), ("s", 5, "plan", "x", None, None), ("s", 6, "tool", None, None, None), ("s", 7, "phase", "three", None, "running"), ("s", 8, "phase", "?", 2, "failed"), ("n", 1, "tool", None, None, None)]
    got = S.track_phases(spark.createDataFrame(e, "session string, seq int, type string, name string, index int, status string")).orderBy("phase").collect()
    # The current phase comes before the one that has the name.
    assert [tuple(r) for r in got] == [("s", 0, "one", "completed", False, 1), ("s", 1, "two", "running", False, 1), ("s", 2, "three", "failed", True, 1)]


def test_milestones_and_progress(spark):
    u = [("s", 1, "a", "in_progress"), ("s", 2, "a", "completed"), ("s", 3, "b", "in_progress"), ("t", 1, "a", "in_progress"), ("t", 2, "z", "failed"), ("v", 1, "b", "completed"), ("v", 2, "a", "completed"), ("v", 3, "b", "completed")]
    got = S.milestone_states(spark.createDataFrame(u, "s string, seq int, m string, st string"), "s", ["seq"], "m", "st").orderBy("s").collect()
    assert [tuple(r) for r in got] == [("s", ["a"], "b"), ("t", None, None), ("v", ["b", "a"], None)]
    df = spark.createDataFrame([(1, 3), (3, 3), (2, 0)], "p int, n int")
    assert [r[0] for r in df.select(S.percent(df.p, df.n)).collect()] == [0, 66, 0]


def test_update_equals_build(spark, tmp_path):
    first = frame(spark, [("a.py", "def f():\n    return alpha\n"), ("b.py", "def g():\n    pass\n"), ("c.txt", "gone words")])
    then = frame(spark, [("a.py", "def f():\n    return alpha\n"), ("b.py", "def h():\n    return beta\n"), ("d.txt", "new words")])
    store.build(first, str(tmp_path / "u"))
    store.update(then, str(tmp_path / "u"))
    store.build(then, str(tmp_path / "b"))
    one, two = store.load(spark, str(tmp_path / "u")), store.load(spark, str(tmp_path / "b"))
    for part in store.PARTS:
        assert sorted(map(str, one[part].select(sorted(one[part].columns)).collect())) == sorted(map(str, two[part].select(sorted(two[part].columns)).collect()))
    assert {(r.type, r.chunks) for r in store.stats(one).collect()} == {("function", 2), ("module", 1)}


def test_tree_is_read(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_bytes(b"x")
    (tmp_path / "d" / "a.txt").write_bytes(b"ok \xff")
    (tmp_path / "d" / "__init__.py").write_bytes(b"")
    (tmp_path / ".env").write_bytes(b"K=1")
    got = {r.path: (r.content, r.size, r.modified is not None) for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"d/a.txt": ("ok \ufffd", 4, True), "d/__init__.py": ("", 0, True), ".env": ("K=1", 3, True)}
    (tmp_path / "none").mkdir()
    assert tree.read_tree(spark, str(tmp_path / "none")).count() == 0


def test_events_without_a_session_are_kept(spark):
    e = spark.createDataFrame([("s", 1, "go"), ("s", 2, "x"), (None, 1, "x"), (None, 2, "go"), (None, 3, "y"), ("t", 1, "x")], "s string, seq int, k string")
    got = S.since_last(e, "s", ["seq"], F.col("k") == "go").collect()
    assert {(r.s, r.seq) for r in got} == {("s", 2), (None, 3), ("t", 1)}


def test_entries_and_what_they_are(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "d" / "e" / "a.txt").write_bytes(b"four")
    (tmp_path / "_b").write_bytes(b"")
    (tmp_path / "d" / "back").symlink_to(tmp_path)
    entries = tree.read_entries(spark, str(tmp_path))
    assert sorted((r.path, r.kind, r.linked, r.size) for r in entries.collect()) == [("_b", "file", False, 0), ("d", "directory", False, None), ("d/back", "directory", True, None), ("d/e", "directory", False, None), ("d/e/a.txt", "file", False, 4)]
    wanted = spark.createDataFrame([("d/e/a.txt",), ("d",), ("none",), (None,)], "path string")
    got = {r.path: r for r in PR.file_info(wanted, entries).collect()}
    one = got["d/e/a.txt"]
    assert one.exists and one.is_file and not one.is_directory and one.size == 4 and one.modified and one.created and one.error is None
    assert got["d"].is_directory and not got["none"].exists and got["none"].error == "File not found: none" and not got[None].exists


def test_listings(spark):
    paths = ["a.py", ".env", "src/b.py", "src/sub/c.txt", "src/.hid/d.py", "node_modules/x.py", None]
    f = spark.createDataFrame([(p,) for p in paths], "path string")
    every = PR.list_entries(f)
    assert {(r.path, r.kind) for r in every.collect()} == {(p, "file") for p in ("a.py", "node_modules/x.py", "src/.hid/d.py", "src/b.py", "src/sub/c.txt")} | {("node_modules", "directory"), ("src", "directory"), ("src/sub", "directory")}
    assert {(r.total_files, r.total_directories, r.truncated) for r in every.collect()} == {(5, 3, False)}
    assert {r.path for r in PR.list_entries(f, recursive=False).collect()} == {"a.py", "src", "node_modules"}
    assert {r.path for r in PR.list_entries(f, "src", "*.py", recursive=False, hidden=True).collect()} == {"src/b.py"}
    assert {r.path for r in PR.list_entries(f, "src/", recursive=False, hidden=True).collect()} == {"src/b.py", "src/sub", "src/.hid"}
    cut = PR.list_entries(f, most=2).collect()
    assert [r.path for r in cut] == ["a.py", "node_modules/x.py"] and all(r.truncated for r in cut)
    assert [(r.path, r["count"]) for r in PR.list_plain(f, pattern="*.py").collect()] == [("a.py", 3), ("src/.hid/d.py", 3), ("src/b.py", 3)]
    assert [r.path for r in PR.list_plain(f, "src", recursive=False).collect()] == ["src/b.py"]


def test_reads_keep_their_limits(spark):
    text = "".join(f"l{i}\n" for i in range(1, 8))
    f = spark.createDataFrame([("a", text), ("big", "x" * 50), ("none", None), ("empty", "")], "path string, content string")
    spans = [(None, None), (2, 3), (3, None), (0, 0), (9, 12), (-2, None), (None, -5), (5, 2)]
    wanted = spark.createDataFrame([("a", i, s, e) for i, (s, e) in enumerate(spans)] + [(p, 99, None, None) for p in ("big", "none", "empty", "gone", None)], "path string, n int, start_line int, end_line int")
    got = {(r.path, r.n): r for r in FI.read(wanted, f, max_bytes=40, max_lines=4).collect()}
    for i, (s, e) in enumerate(spans):
        want = text.splitlines()
        want = want if s is None and e is None else want[(s or 1) - 1 : e or 7]
        r = got["a", i]
        assert (r.content, r.total_lines, r.lines, r.truncated, r.error) == ("\n".join(want[:4]), 7, min(len(want), 4), len(want) > 4, None), (s, e)
    assert got["big", 99].error == "File too large: 50 bytes (max: 40)" and got["big", 99].content is None
    assert got["none", 99].error == "File not found: none" and got["gone", 99].size is None and got[None, 99].error
    assert (got["empty", 99].content, got["empty", 99].total_lines) == ("", 0)
    assert FI.read_plain(wanted.where("n = 0"), f, 2).first()["content"] == "l1\nl2\n... (truncated)"
    batches = spark.createDataFrame([(1, "a"), (1, "gone")] + [(2, "a")] * 11, "batch int, path string")
    rows = {r.batch: r for r in FI.read_batches(batches, f).collect()}
    assert [(x.path, x.lines, x.error) for x in rows[1].files] == [("a", 7, None), ("gone", 0, "File not found: gone")]
    assert (rows[1]["count"], rows[1].successful, rows[1].total_lines) == (2, 1, 7)
    assert (rows[2]["count"], rows[2].files, rows[2].error) == (11, None, "Maximum 10 files per batch")
