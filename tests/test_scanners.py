"""Scanners of scripts, SQL, symbols and Markdown; diffs and outlines of projects."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarryline.operators import diffs as DF
from quarryline.operators import project as PR
from quarryline.sources import code, lexer, markdown, outline


def test_script_code_keeps_places():
    text = "a('}') // }\nb(`x ${c({d: '}'})} } ${`in ${e} }`}`) /* } \n */ + /[/}]\\/}/g.test(f) / g"
    got = lexer.script_code(text)
    assert len(got) == len(text) and [m.start() for m in re.finditer("\n", got)] == [m.start() for m in re.finditer("\n", text)]
    assert re.findall(r"\w+", got) == ["a", "b", "c", "d", "e", "test", "f", "g"] and got.count("{") == got.count("}")
    assert "".join(re.findall(r"[{}]", lexer.script_code("`a ${ `b ${ {x: 1} } c` } d` + {}"))) == "{{{}}}{}"


def test_braces_in_texts_do_not_end_a_function():
    text = "function f(a = '}', b = {c: 1}) {\n  // }\n  if (a) { return '}'; }\n  return `}${g({x: '{'})}`;\n}\nconst h = async (x) => {\n  const r = /[{]/;\n  return k(x);\n};\nclass A extends B {\n  m() { return \"}\"; }\n}\nexport default function last() { '{' }\nlet tail = 1"
    got = {r["name"]: r for r in code.script_chunks("s.js", text)}
    assert list(got) == ["f", "h", "A", "last"]
    assert got["f"]["content"].endswith("`}${g({x: '{'})}`;\n}") and got["f"]["calls"] == ["g"] and got["f"]["signature"] == "function f(a = '}', b = {c: 1})"
    assert got["h"]["content"].endswith("k(x);\n}") and got["h"]["calls"] == ["k"] and (got["A"]["line_start"], got["A"]["line_end"]) == (10, 12)
    assert got["last"]["content"] == "export default function last() { '{' }"


def test_sql_statements():
    text = (
        "-- CREATE TABLE no (a int);\nCREATE TABLE s.t (\n a int DEFAULT 1, \"b c\" text CHECK (x IN (1, 2)), c numeric(1, 2), d int, e int, f int,\n PRIMARY KEY (a), FOREIGN KEY (c) REFERENCES o (id)\n);\n"
        "CREATE FUNCTION f() RETURNS int AS $$ BEGIN; SELECT ';' FROM u JOIN w ON 1=1; END; $$ LANGUAGE sql;\nCREATE TABLE small (x int);\n"
        "CREATE TRIGGER g AFTER INSERT ON t BEGIN UPDATE t2 SET a = CASE WHEN 1 THEN 2 END; DELETE FROM t3; END;\nINSERT INTO x VALUES ('CREATE VIEW no AS');\nCREATE VIEW v AS SELECT ';' AS a FROM t; SELECT 1"
    )
    got = {r["id"]: r for r in code.sql_chunks("q", text)}
    assert list(got) == ["q:table:s.t", "q:function:f", "q:table:small", "q:trigger:g", "q:view:v"]
    assert got["q:table:s.t"]["signature"] == "CREATE TABLE s.t (a, b c, c, d, e...)" and got["q:table:small"]["signature"] == "CREATE TABLE small (x)" and got["q:table:s.t"]["imports"] == ["o"]
    assert got["q:function:f"]["content"].endswith("END; $$ LANGUAGE sql;") and got["q:function:f"]["imports"] == ["u", "w"]
    assert got["q:trigger:g"]["content"].endswith("DELETE FROM t3; END;") and got["q:trigger:g"]["imports"] == ["t", "t2", "t3"] and got["q:view:v"]["imports"] == ["t"]
    assert (got["q:table:s.t"]["line_start"], got["q:view:v"]["line_start"]) == (2, 10)


def test_dotted_bases():
    got = code.python_chunks("a.py", "class B(mod.Base, C, metaclass=M):\n    pass\n")
    assert got[0]["imports"] == ["Base", "C"]


def by_patterns(text):
    """Definitions as two patterns over the whole text find them."""
    out = [(text.count("\n", 0, m.start()) + 1, m[1], "class", "") for m in re.finditer(r"^class\s+(\w+)", text, re.M)]
    for m in re.finditer(r"^(\s*)def\s+(\w+)\s*\(([^)]*)\)", text, re.M):
        out.append((text.count("\n", 0, m.start()) + 1, m[2], "method" if m[1] else "function", f"({m[3]})"))
    return sorted(out)


def test_symbols_equal_the_patterns(spark):
    rng = random.Random(1)
    parts = ["def f(a, b):", "    def m(self,", "          x):", "class A:", "  class B:", "", "", "   ", "x = 1", "def g():", "\tdef t(a): pass", "# def no(", "def open_(", "y)", "async def z(q):"]
    rows = [(str(i), "\n".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(150)]
    got = {}
    for r in outline.pattern_symbols(spark.createDataFrame(rows, "path string, content string")).collect():
        got.setdefault(r.path, []).append((r.line, r.name, r.kind, r.signature))
    assert {p: sorted(x) for p, x in got.items()} == {p: w for p, t in rows if (w := by_patterns(t))}


def test_symbols_take_linear_time(spark):
    took = []
    for n in (200, 1000, 4000):
        rows = [("p", "".join(f"\n\ndef f{i}(a,\n      b):\n    pass\n" for i in range(n)))]
        df = spark.createDataFrame(rows, "path string, content string")
        began = time.time()
        assert outline.pattern_symbols(df).count() == n
        took.append(time.time() - began)
    assert took[2] < 6 * took[1] + 2, took


def walked(body):
    """Sections line by line."""
    found, fence, lines = [], None, body.split("\n")
    for i, x in enumerate(lines, 1):
        if x[:3] == "```":
            if fence and found:
                found[-1][3].append((fence[0], "\n".join(fence[1])))
            fence = None if fence else (x[3:].strip(), [])
        elif fence:
            fence[1].append(x)
        elif m := re.match(r"(#{1,6})\s+(.+)$", x):
            found.append([m[2].strip(), len(m[1]), [], [], i])
        elif found:
            found[-1][2].append(x)
    ends = [f[4] - 1 for f in found[1:]] + [len(lines)]
    return [(h, n, "\n".join(c).strip(), b, s, e) for (h, n, c, b, s), e in zip(found, ends)]


def test_sections_equal_a_walk(spark):
    rng = random.Random(2)
    parts = ["# One", "## Two  ", "###### six", "####### seven", "#none", "# ", "#  ", "\t", "text", "more # text", "```", "```py", "``` sql ", "````", "  ```", "# in code?", "", "", "é x", "\r", "#\ttab", "$1 \\ x"]
    rows = [(i, "\n".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(400)]
    got = spark.createDataFrame(rows, "i int, body string").select("i", markdown.section_list(F.col("body")).alias("s")).collect()
    for r in got:
        assert [(s.heading, s.level, s.content, [(b.language, b.code) for b in s.code_blocks], s.start_line, s.end_line) for s in r.s] == walked(rows[r.i][1]), repr(rows[r.i][1])


def test_sections_take_linear_time(spark):
    took = []
    for n in (500, 8000):
        body = "".join(f"# h{i}\n```py\nx = {i}\n```\ntext {i}\n" for i in range(n))
        df = spark.createDataFrame([(body,)], "body string").select(markdown.section_list(F.col("body")).alias("s"))
        began = time.time()
        last = df.select(F.size("s").alias("n"), F.element_at("s", -1).alias("s")).first()
        took.append(time.time() - began)
        assert (last.n, last.s.heading, last.s.content, last.s.code_blocks[0].code, last.s.start_line) == (n, f"h{n - 1}", f"text {n - 1}", f"x = {n - 1}", 5 * n - 4)
    assert took[1] < 16 * took[0] + 3, took


# --- diffs


def test_applied_diffs_give_the_new_text(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        old = [rng.choice(["a", "b", "c", "", "d\r", "--- x", "+++ y", "@@ -1 +1 @@", "\\ z"]) for _ in range(rng.randint(0, 30))]
        new = [x for x in old if rng.random() > 0.15]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), rng.choice(["n", "m", ""]))
        rows.append((f"p{i}", "\n".join(old) + "\n" * rng.randint(0, 1), "\n".join(new) + "\n" * rng.randint(0, 1)))
    pairs = spark.createDataFrame(rows, "path string, old string, new string")
    done = DF.apply_diffs(pairs.selectExpr("path", "old as content"), DF.unified_diff(pairs)).collect()
    assert {(r.path, r.content, r.error) for r in done} == {(p, n, None) for p, _, n in rows}


def test_diffs_that_do_not_fit(spark):
    diff = DF.unified("f", "a\nb\nc\n", "a\nB\nc\n")
    assert DF.apply_unified("a\nb\nc\n", diff) == "a\nB\nc\n"
    for text in ("a\nx\nc\n", "a\nb\n", "b\nc\na\n", "a\nb\nc", ""):
        with pytest.raises(ValueError):
            DF.apply_unified(text, diff)
    with pytest.raises(ValueError):
        DF.apply_unified("a\nb\nc\n", diff.rsplit("\n", 2)[0])
    files = spark.createDataFrame([("one", "other\n"), ("two", "kept"), ("gone", None)], "path string, content string")
    diffs = spark.createDataFrame([("one", diff), ("new", DF.unified("new", "", "x\ny"))], "path string, diff string")
    got = {r.path: (r.content, r.error is None) for r in DF.apply_diffs(files, diffs).collect()}
    assert got == {"one": ("other\n", False), "two": ("kept", True), "gone": (None, True), "new": ("x\ny", True)}


def test_inline_diff(spark):
    got = DF.inline_diff(spark.createDataFrame([("f", "a\nb\nc", "a\nx\ny\nc\nd"), ("g", None, "z")], "path string, old string, new string")).orderBy("path", "position").collect()
    assert [(r.path, r.mark + r.line) for r in got] == [("f", " a"), ("f", "-b"), ("f", "+x"), ("f", "+y"), ("f", " c"), ("f", "+d"), ("g", "-"), ("g", "+z")]


def test_expired_backups(spark):
    now = dt.datetime(2024, 5, 2, 12)
    rows = [("old", now - dt.timedelta(hours=25)), ("edge", now - dt.timedelta(hours=24)), ("new", now)]
    assert [r.path for r in DF.expired(spark.createDataFrame(rows, "path string, modified timestamp"), F.lit(now)).collect()] == ["old"]


# --- outlines


def drawn(paths, root="project", per_dir=30, depth=4, most=200):
    tree = {}
    for p in paths:
        at = tree
        for x in p.split("/"):
            at = at.setdefault(x, {})
    lines = [f"{root}/"]

    def walk(at, prefix, level):
        if level > depth:
            return
        names = sorted(at, key=lambda n: (not at[n], n.lower(), n))
        for i, n in enumerate(names[:per_dir]):
            end = i == len(names) - 1
            lines.append(f"{prefix}{'└── ' if end else '├── '}{n}{'/' if at[n] else ''}")
            walk(at[n], prefix + ("    " if end else "│   "), level + 1)

    walk(tree, "", 0)
    return lines[:most]


def test_trees_are_drawn_depth_first(spark):
    rng = random.Random(4)
    names = ["a", "B", "c", "src", "Lib", "x1", "é"]
    for k, (per_dir, depth, most) in enumerate(((30, 4, 200), (2, 1, 200), (3, 6, 12))):
        paths = {"/".join([*rng.choices(names, k=rng.randint(0, 6)), f"f{rng.randrange(60)}.py"]) for _ in range(80)}
        df = spark.createDataFrame([(p,) for p in [*paths, "node_modules/a.js", "src/x.pyc", "build/y"]], "path string")
        got = [r.line for r in PR.skeleton_tree(df, per_dir=per_dir, depth=depth, most=most).orderBy("position").collect()]
        assert got == drawn(paths, per_dir=per_dir, depth=depth, most=most), k
    assert [r.line for r in PR.skeleton_tree(df.where("false")).collect()] == ["project/"]


def test_skeleton_parts(spark):
    files = spark.createDataFrame([("a.py", "import os\nfrom x import y\n\ndef f(a):\n    pass"), ("d/b.js", "one\ntwo"), ("dist/c.py", "import no"), ("n.py", None)], "path string, content string")
    got = PR.skeleton(files, outline.pattern_symbols(files)).orderBy("kind", "position").collect()
    assert [(r.kind, r.path, r.text) for r in got] == [
        ("dependency", "a.py", "import os\nfrom x import y"), ("symbol", "a.py", "method f(a):3"), ("total", "files", "3"), ("total", "lines", "7"),
        ("tree", None, "project/"), ("tree", None, "├── d/"), ("tree", None, "│   └── b.js"), ("tree", None, "├── a.py"), ("tree", None, "└── n.py"),
    ]
