"""Scans, listings, bounded reads, counts and edits of files kept as rows (path, content)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import KEYWORD_STOP_WORDS, lines, split_lines
from .diffs import unified_diff as unified_diff

MAX_READ = 100 * 1024


def project_scan(files: DataFrame) -> DataFrame:
    """Files that are indexed: no ignored directory or name, a known extension."""
    return files.where(~P.ignored_exact(F.col("path")) & F.lower(P.suffix(F.col("path"))).isin(*P.INDEXED))


def context_scan(files: DataFrame, limit: int = 500) -> DataFrame:
    """The first limit paths, in order, of which no part is ignored."""
    return files.where(~P.ignored_any(F.col("path"))).orderBy("path").limit(limit)


def listing(files: DataFrame, pattern: str = "*", limit: int = 500, hidden: bool = False) -> DataFrame:
    """(path, truncated): the first limit paths whose name matches, in order."""
    own = files.where(P.matches_any(P.name(F.col("path")), [pattern]))
    if not hidden:
        own = own.where(~P.name(F.col("path")).startswith("."))
    first = own.select("path").orderBy("path").limit(limit)
    return first.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) >= limit)  # at most limit rows


def directories(files: DataFrame) -> DataFrame:
    """(path): every directory above a file, each once; the root isn't among them."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.where(F.contains("path", F.lit("/"))).select(F.explode(up).alias("path")).distinct()


def list_entries(files: DataFrame, root: str = "", pattern: str | None = None, recursive: bool = True, hidden: bool = False, most: int = 500, most_dirs: int = 50) -> DataFrame:
    """(path, kind, total_files, total_directories, truncated): what is below root (recursive) or right in it, by kind ('file'
    before 'directory') and path: the first ``most`` files and ``most_dirs`` directories whose name matches. The totals count
    what is listed up to ``most`` files and directories together, in that order; truncated: there were ``most`` files or more.
    Only names are tested for a leading dot, so files in a hidden directory are listed.
    """
    both = files.select("path", F.lit(0).alias("k")).unionAll(directories(files).select("path", F.lit(1).alias("k")))
    top = root.strip("/")
    below = F.col("path").startswith(top + "/") if top else F.lit(True)
    own = both.where("path is not null").where(below)
    if not recursive:
        own = own.where(~F.contains(F.substr("path", F.lit(len(top) + 2 if top else 1)), F.lit("/")))
    if not hidden:
        own = own.where(~P.name(F.col("path")).startswith("."))
    if pattern:
        own = own.where(P.matches_any(P.name(F.col("path")), [pattern]))
    first = own.orderBy("k", "path").limit(most)
    all_of = Window.partitionBy(F.lit(0))  # at most `most` rows
    place = F.row_number().over(Window.partitionBy("k").orderBy("path"))
    total = lambda k: F.count_if(F.col("k") == k).over(all_of)
    out = first.select("path", F.when(F.col("k") == 0, "file").otherwise("directory").alias("kind"), place.alias("place"), total(0).alias("total_files"), total(1).alias("total_directories"))
    return out.where((F.col("kind") == "file") | (F.col("place") <= most_dirs)).withColumn("truncated", F.col("total_files") >= most).drop("place")


def list_plain(files: DataFrame, root: str = "", pattern: str | None = None, recursive: bool = True, most: int = 500) -> DataFrame:
    """(path, count): the first ``most`` files below root (recursive) or right in it, in order, of whose parts below root none is
    ignored and whose name matches; count: how many are listed."""
    top = root.strip("/")
    rest = F.substr("path", F.lit(len(top) + 2 if top else 1))
    own = files.where("path is not null").where(F.col("path").startswith(top + "/") if top else F.lit(True)).where(~P.ignored_any(rest))
    own = own if recursive else own.where(~F.contains(rest, F.lit("/")))
    own = own.where(P.matches_any(P.name(F.col("path")), [pattern])) if pattern else own
    first = own.select("path").orderBy("path").limit(most)
    return first.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # at most `most` rows


def stat(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (path) with exists and the size in bytes (null: missing)."""
    have = files.select("path", F.octet_length(F.coalesce("content", F.lit(""))).alias("size"))
    return wanted.join(have, "path", "left").select("path", F.col("size").isNotNull().alias("exists"), "size")


def file_info(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted (path) with exists, is_file, is_directory, size, modified, created and error, from entries (path, kind, size, modified,
    created; as sources.tree.read_entries). A missing path has an error, and null but for exists; a null path is one."""
    have = entries.select("path", "kind", "size", "modified", "created")
    missing = F.col("kind").isNull()
    return wanted.join(have, "path", "left").select(
        "path", (~missing).alias("exists"), (F.col("kind") == "file").alias("is_file"), (F.col("kind") == "directory").alias("is_directory"),
        "size", "modified", "created", F.when(missing, F.concat(F.lit("File not found: "), F.coalesce("path", F.lit("")))).alias("error"),
    )


def bounded_read(files: DataFrame, max_lines: int = 300, max_bytes: int = MAX_READ) -> DataFrame:
    """(path, content, lines) of readable files up to max_bytes; beyond max_lines a marker follows."""
    text = F.coalesce("content", F.lit(""))
    own = files.where(F.lower(P.suffix(F.col("path"))).isin(*P.READABLE) & (F.octet_length(text) <= max_bytes)).select("path", text.alias("content"), split_lines(text).alias("l"))
    cut = F.concat(F.array_join(F.slice("l", 1, max_lines), "\n"), F.lit("\n... (truncated)"))
    return own.select("path", F.when(F.size("l") > max_lines, cut).otherwise(F.col("content")).alias("content"), F.least(F.size("l"), F.lit(max_lines)).alias("lines"))


def root_config(files: DataFrame) -> DataFrame:
    """Readable configuration files at the root: no lock files, no Markdown."""
    name = F.col("path")
    config = F.lower(P.suffix(name)).isin(*P.CONFIG_EXTENSIONS) | name.isin(*P.CONFIG_NAMES) | name.startswith(".")
    own = files.where(~name.contains("/") & ~P.matches_any(name, P.IGNORE_ANY) & ~name.isin(*P.LOCK_FILES) & ~name.endswith(".md") & config)
    return bounded_read(own)


def mentioned(files: DataFrame, instruction: str) -> DataFrame:
    """Files whose name or path occurs in the instruction, whatever the case."""
    said = F.lit(instruction.lower())
    return files.where(said.contains(F.lower(P.name(F.col("path")))) | said.contains(F.lower(F.col("path"))))


def collect_files(files: DataFrame, instruction: str, max_files: int = 10, max_chars: int = 50_000) -> DataFrame:
    """(position, path, content): mentioned files, then key files; the first max_files, passing over one that would
    make the total exceed max_chars. Only those max_files rows meet in one task."""
    key = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(P.KEY_FILES))):
        key = F.when(F.col("path").endswith(k), i).otherwise(key)
    said = F.lit(instruction.lower())
    named = said.contains(F.lower(P.name(F.col("path")))) | said.contains(F.lower(F.col("path")))
    place = F.when(named, -1).otherwise(key)
    first = files.select("path", "content", place.alias("place")).where("place is not null").orderBy("place", "path").limit(max_files)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("place", "path", "content"))), lambda r: F.struct(r["path"].alias("path"), F.coalesce(r["content"], F.lit("")).alias("content")))
    start = F.struct(F.lit(0).alias("used"), F.slice(F.col("r"), 1, 0).alias("kept"))
    step = lambda a, x: F.when(a["used"] + F.length(x["content"]) <= max_chars, F.struct((a["used"] + F.length(x["content"])).alias("used"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    return first.agg(rows.alias("r")).select(F.posexplode(F.aggregate("r", start, step)["kept"]).alias("position", "f")).select("position", "f.path", "f.content")


def relevance(path: Column, instruction: str) -> Column:
    """How well a path suits an instruction: named in it 100; for each keyword 10 in the path, 20 in the name, 50 as the
    stem; 5 for entry points; 2 or 1 by extension."""
    said = F.lit(instruction.lower())
    keywords = [w for w in re.findall(r"\w+", instruction.lower()) if len(w) > 2 and w not in KEYWORD_STOP_WORDS]
    whole, name, stem, ext = F.lower(path), F.lower(P.name(path)), F.lower(P.stem(path)), F.lower(P.suffix(path))
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(said.contains(name) | said.contains(stem), 100) + points(stem.isin(*P.ENTRY_POINTS), 5)
    score = score + points(ext.isin(*P.CODE_BONUS), 2) + points(ext.isin(*P.DATA_BONUS), 1)
    if keywords:
        each = lambda a, k: a + points(whole.contains(k), 10) + points(name.contains(k), 20) + points(stem == k, 50)
        score = score + F.aggregate(F.array(*map(F.lit, keywords)), F.lit(0), each)
    return score


def relevant_files(files: DataFrame, instruction: str, limit: int = 15) -> DataFrame:
    """The files with the highest relevance above 0, with score; ties by path."""
    return files.withColumn("score", relevance(F.col("path"), instruction)).where("score > 0").orderBy(F.desc("score"), "path").limit(limit)


def collect_context(files: DataFrame, instruction: str, limit: int = 15, small: int = 10) -> DataFrame:
    """(position, path, content, lines): the root's configuration files, then relevant files that aren't among them, up to
    limit in all; one relevant file counts even where configuration takes all places. In a project of up to ``small``
    files of which under three are relevant, every file counts as relevant.

    No more than the 500 paths of a scan and the root's files meet in one task.
    """
    scan = context_scan(files)
    scored = relevant_files(scan, instruction, limit)
    counts = scan.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if counts <= small and relevant_files(scan, instruction, 3).count() < 3:
        scored = scan.withColumn("score", F.lit(0))
    config = root_config(files).withColumn("kind", F.lit(0)).withColumn("score", F.lit(0))
    read = bounded_read(scored).where("content <> ''").join(scored.select("path", "score"), "path").join(config.select("path"), "path", "left_anti").withColumn("kind", F.lit(1))
    both = config.where("content <> ''").unionByName(read)
    own = Window.partitionBy("kind").orderBy(F.desc("score"), "path")
    room = F.greatest(F.lit(limit) - F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(Window.partitionBy(F.lit(0))), F.lit(1))
    kept = both.withColumn("r", F.row_number().over(own)).withColumn("room", room).where((F.col("kind") == 0) | (F.col("r") <= F.col("room")))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("kind", "r")) - 1
    return kept.select(place.alias("position"), "path", "content", "lines")


def module_chunks(files: DataFrame, max_lines: int = 200) -> DataFrame:
    """(id, name, content, line_end): each file up to 100 KB as one chunk of its first lines."""
    text = F.coalesce("content", F.lit(""))
    own = files.where(F.octet_length(text) <= MAX_READ).select("path", lines(text).alias("l"))
    body = F.array_join(F.slice("l", 1, max_lines), "\n")
    return own.select(F.concat("path", F.lit(":module")).alias("id"), P.stem(F.col("path")).alias("name"), F.when(F.size("l") > max_lines, F.concat(body, F.lit("\n... (truncated)"))).otherwise(body).alias("content"), F.size("l").alias("line_end"))


def import_lines(files: DataFrame, starts: tuple[str, ...] = ("import ", "from "), head: int = 100, most: int = 20) -> DataFrame:
    """(path, position, line): the first lines of a file's head that begin with one of starts."""
    trimmed = F.transform(F.slice(lines(F.col("content")), 1, head), lambda x: F.trim(x))
    hit = lambda x: F.exists(F.array(*map(F.lit, starts)), lambda s: x.startswith(s))
    return files.select("path", F.posexplode(F.slice(F.filter(trimmed, hit), 1, most)).alias("position", "line"))


def write_counts(files: DataFrame) -> DataFrame:
    """(path, lines, bytes) as a writer reports them."""
    text = F.coalesce("content", F.lit(""))
    return files.select("path", F.size(split_lines(text)).alias("lines"), F.octet_length(text).alias("bytes"))


def write_summary(files: DataFrame) -> DataFrame:
    """One row: files written, errors (null contents), lines, bytes, and whether any was written."""
    text = F.coalesce("content", F.lit(""))
    counted = files.select(F.col("content").isNull().alias("bad"), F.size(split_lines(text)).alias("lines"), F.octet_length(text).alias("bytes"))
    ok = ~F.col("bad")
    return counted.agg(F.count_if(ok).alias("written"), F.count_if("bad").alias("errors"), F.coalesce(F.sum(F.when(ok, F.col("lines"))), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes"), (F.count_if(ok) > 0).alias("success"))


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files (path, content) after changes (seq, type, path, content, search, replace), in order of seq within a file.

    Returns (path, content, applied, failed); null content: the file doesn't exist. An edit needs the file and the text
    it searches, and replaces the first occurrence; an empty search puts the replacement at the start. A file's changes
    meet in one row.
    """
    c = changes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "content", "search", "replace"))).alias("changes"))
    start = F.struct(F.col("content").alias("text"), F.lit(0).alias("applied"), F.lit(0).alias("failed"))

    def step(a, x):
        search, text = F.coalesce(x["search"], F.lit("")), a["text"]
        at = F.position(search, text)
        edited = F.when(search == "", F.concat(F.coalesce(x["replace"], F.lit("")), text)).when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.coalesce(x["replace"], F.lit("")), F.substr(text, at + F.length(search))))
        new = F.when(x["type"] == "create", F.coalesce(x["content"], F.lit(""))).when(x["type"] == "edit", edited)
        ok = F.when(x["type"] == "delete", text.isNotNull()).otherwise(new.isNotNull())
        return F.struct(F.when(~ok, text).otherwise(new).alias("text"), (a["applied"] + ok.cast("int")).alias("applied"), (a["failed"] + (~ok).cast("int")).alias("failed"))

    both = files.select("path", "content").join(c, "path", "full_outer")
    done = both.select("path", F.aggregate(F.coalesce("changes", F.array().cast(c.schema["changes"].dataType)), start, step).alias("r"))
    return done.select("path", F.col("r.text").alias("content"), "r.applied", "r.failed")


def tree_rows(files: DataFrame, per_dir: int = 30, depth: int = 4) -> DataFrame:
    """(parent, name, is_dir, position): entries of each directory, directories first, then by lower-case name."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    each = files.select(parts.alias("p")).where("size(p) > 0").select("p", F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(depth + 1)))).alias("d"))
    entry = each.select(F.expr("array_join(slice(p, 1, d - 1), '/')").alias("parent"), F.expr("p[d - 1]").alias("name"), F.expr("d < size(p)").alias("is_dir")).distinct()
    w = Window.partitionBy("parent").orderBy(F.desc("is_dir"), F.lower("name"), "name")
    return entry.withColumn("position", F.row_number().over(w)).where(F.col("position") <= per_dir)


# Parts of a path that a skeleton leaves out, and ends of names.
SKELETON_PARTS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", "target", ".pytest_cache", ".mypy_cache", ".DS_Store")
SKELETON_ENDS = (".pyc", ".pyo")
SKELETON_LINES = 200


def _in_skeleton(path: Column) -> Column:
    out = F.lit(True)
    for x in SKELETON_PARTS:
        out = out & ~path.contains(x)
    for x in SKELETON_ENDS:
        out = out & ~path.endswith(x)
    return out


def skeleton_tree(files: DataFrame, root: str = "project", per_dir: int = 30, depth: int = 4, most: int = SKELETON_LINES) -> DataFrame:
    """(position, line): the drawn tree of files (path), depth first, directories first and then by lower-case name, with the
    first per_dir entries of a directory and ``most`` lines in all, the root's included.

    An entry's place is the list of its ancestors' places, itself last; lists are compared from the left, so sorting by
    them is the walk. An entry's line needs to know of each ancestor whether it is the last of its directory, so entries
    meet their at most depth + 1 ancestors by path.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    each = files.where(_in_skeleton(F.col("path"))).select(parts.alias("p")).where("size(p) > 0")
    each = each.select("p", F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(depth + 1)))).alias("d"))
    own = each.select(F.expr("array_join(slice(p, 1, d), '/')").alias("own"), F.expr("array_join(slice(p, 1, d - 1), '/')").alias("parent"), F.expr("p[d - 1]").alias("name"), F.expr("d < size(p)").alias("is_dir"), F.expr("slice(p, 1, d)").alias("p"))
    own = own.groupBy("own", "parent", "name", "p").agg(F.max("is_dir").alias("is_dir"))
    w = Window.partitionBy("parent")
    place = F.row_number().over(w.orderBy(F.desc("is_dir"), F.lower("name"), "name"))
    entries = own.withColumn("place", place).withColumn("last", F.col("place") == F.count(F.lit(1)).over(w)).where(F.col("place") <= per_dir)
    above = entries.select("own", "name", "is_dir", F.size("p").alias("d"), F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", F.lit(1), i), "/"))).alias("up"))
    known = entries.select(F.col("own").alias("up"), F.size("p").alias("level"), "place", "last")
    met = above.join(known, "up").groupBy("own", "name", "is_dir", "d").agg(F.array_sort(F.collect_list(F.struct("level", "place", "last"))).alias("ups"))
    shown = met.where(F.size("ups") == F.col("d")).withColumn("walk", F.transform("ups", lambda x: x["place"])).orderBy("walk").limit(most - 1)
    bars = F.array_join(F.transform(F.slice("ups", F.lit(1), F.size("ups") - 1), lambda x: F.when(x["last"], "    ").otherwise("│   ")), "")
    line = F.concat(bars, F.when(F.element_at("ups", -1)["last"], "└── ").otherwise("├── "), "name", F.when(F.col("is_dir"), "/").otherwise(""))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("walk"))  # of `most` rows at most
    top = files.sparkSession.range(1).select(F.lit(0).alias("position"), F.lit(f"{root}/").alias("line"))
    return top.unionByName(shown.select(number.alias("position"), line.alias("line")))


def skeleton(files: DataFrame, symbols: DataFrame, root: str = "project", depth: int = 4) -> DataFrame:
    """(kind, position, path, text): the parts of a project's outline, from files (path, content) and symbols (path, name, kind,
    line, signature): 'tree' lines, the first 100 'symbol' rows of the 500 first by path and line, the imports of the
    first 50 files that have any as 'dependency', and 'total' rows for files and lines."""
    own = files.where(_in_skeleton(F.col("path")))
    tree = skeleton_tree(files, root, depth=depth).select(F.lit("tree").alias("kind"), "position", F.lit(None).cast("string").alias("path"), F.col("line").alias("text"))
    seen = symbols.where(_in_skeleton(F.col("path"))).orderBy("path", "line", "name").limit(100)
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path", "line", "name"))  # of 100 rows
    named = seen.select(F.lit("symbol").alias("kind"), at.alias("position"), "path", F.concat(F.col("kind"), F.lit(" "), "name", F.coalesce("signature", F.lit("")), F.lit(":"), "line").alias("text"))
    used = import_lines(own.where(F.col("path").endswith(".py") & F.col("content").isNotNull()))
    used = used.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("text")).orderBy("path").limit(50)  # 20 lines of a file at most
    needs = used.select(F.lit("dependency").alias("kind"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")).alias("position"), "path", "text")  # of 50 rows
    sums = own.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.when(F.col("content").isNotNull(), F.size(F.split("content", "\n")))), F.lit(0)).alias("lines"))
    totals = sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("path"), F.col(c).cast("string").alias("text")) for i, c in enumerate(("files", "lines"))])).alias("t")).select(F.lit("total").alias("kind"), "t.*")
    return tree.unionByName(named).unionByName(needs).unionByName(totals)
