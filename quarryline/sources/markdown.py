"""Front matter and sections of Markdown documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "struct<language: string, code: string>"
HEAD = "path string, title string, fallback string, summary string, tags array<string>, priority int, full_content string"
# Named priorities.
PRIORITY = {"critical": 100, "high": 80, "medium": 50, "low": 20}


def _plain(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value


def front_matter(text: str) -> tuple[dict[str, str | list[str]], str]:
    """Scalars and lists (in brackets, or an item a line) between two lines of dashes, and what follows them."""
    m = re.match(r"---(.*?)\n---\s*\n", text, re.S)
    if not m:
        return {}, text
    out: dict[str, str | list[str]] = {}
    key = ""
    for line in m[1].split("\n"):
        if item := re.match(r"\s*-\s+(.+)$", line):
            if key and out[key] in ("", []) or isinstance(out.get(key), list):
                out[key] = [*(out[key] or []), _plain(item[1])]
        elif ":" in line:
            key, _, value = (x.strip() for x in line.partition(":"))
            listed = value.startswith("[") and value.endswith("]")
            out[key] = [_plain(v) for v in value[1:-1].split(",") if v.strip()] if listed else value
    return out, text[m.end() :].strip()


_TRIM = r"(?U)^\s+|\s+\z"
#: Stand for a fenced block and for each further line of it; in a text these two characters become U+FFFD.
_HELD, _MORE = "\u0000", "\u0001"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once. What a lambda uses from outside is evaluated anew for each element, unless it is
    itself a variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def section_list(body: Column) -> Column:
    """The sections of Markdown text as array of struct(heading, level, content, code_blocks, start_line, end_line).

    Text before the first heading is dropped; fenced code belongs to its section, apart from the content; an open fence
    takes all that follows. Lines count from 1. The text is split at its fences, the parts between two become marks of as many
    lines, and what is left is split into lines, among which the headings stand. Each step is evaluated once a text.
    """
    text = lambda b: F.translate(b, _HELD + _MORE, "\ufffd\ufffd")
    split = lambda x: F.struct(F.split(x, "(?dm)^```.*$", -1).alias("parts"), F.regexp_extract_all(x, F.lit("(?dm)^```(.*)$"), F.lit(1)).alias("langs"))
    return _bound(text(body), lambda x: _bound(split(x), _sections))


def _sections(v: Column) -> Column:
    """The sections of a text of which v holds the parts around fence lines and what follows each fence."""
    n = F.size(v["parts"])
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    mark = lambda x, i: F.concat(F.lit(_HELD), F.when(i < n - 1, F.floor(i / 2).cast("string")).otherwise("-"), F.repeat(F.lit("\n" + _MORE), breaks(x)))
    masked = F.array_join(F.transform(v["parts"], lambda x, i: F.when(i % 2 == 1, mark(x, i)).otherwise(x)), "")

    def code(mark: Column) -> Column:
        at = F.substr(mark, F.lit(2)).cast("int")
        own = F.regexp_replace(F.regexp_replace(F.get(v["parts"], 2 * at + 1), r"^\n", ""), r"\n\z", "")
        return F.struct(F.regexp_replace(F.get(v["langs"], 2 * at), _TRIM, "").alias("language"), own.alias("code"))

    def one(lines: Column, start: Column, end: Column) -> Column:
        line = F.get(lines, start - 1)
        own = F.slice(lines, start + 1, end - start)
        content = F.array_join(F.filter(own, lambda x: ~x.startswith(_HELD) & ~x.startswith(_MORE)), "\n")
        blocks = F.transform(F.filter(own, lambda x: x.startswith(_HELD) & (x != _HELD + "-")), code)
        return F.struct(
            F.regexp_replace(F.regexp_replace(line, "^#{1,6}", ""), _TRIM, "").alias("heading"), F.length(F.regexp_extract(line, "^#{1,6}", 0)).alias("level"),
            F.regexp_replace(content, _TRIM, "").alias("content"), blocks.alias("code_blocks"), start.alias("start_line"), end.alias("end_line"),
        )

    def placed(w: Column) -> Column:
        end = lambda i: F.coalesce(F.get(w["starts"], i + 1) - 1, F.size(w["lines"]))
        return F.transform(w["starts"], lambda at, i: one(w["lines"], at, end(i)))

    headed = lambda x: x.rlike(r"(?U)^#{1,6}[^\S\n]+[^\n]")
    starts = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(headed(x), i + 1)), lambda at: at.isNotNull())
    return _bound(F.split(masked, "\n", -1), lambda lines: _bound(F.struct(lines.alias("lines"), starts(lines).alias("starts")), placed))


def head(path: str, text: str | None) -> dict:
    """What a document's front matter says, and its body."""
    meta, body = front_matter(text or "")
    given = meta.get("priority", "")
    given = given if isinstance(given, str) else ""
    tags = meta.get("tags", [])
    text_of = lambda k: _plain(v) if isinstance(v := meta.get(k, ""), str) else ""
    return {
        "path": path, "title": text_of("title"), "fallback": PurePosixPath(path or "").stem.replace("_", " ").title(), "summary": text_of("summary"),
        "tags": tags if isinstance(tags, list) else [], "priority": int(given) if re.fullmatch(r"-?\d{1,9}", given) else PRIORITY.get(_plain(given).lower(), 50), "full_content": body,
    }


def parsed(files: DataFrame) -> DataFrame:
    """files (path, content) to one row per document: what :func:`head` gives, and sections."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HEAD.split(", ")]
        for b in batches:
            yield pd.DataFrame([head(p, c) for p, c in zip(b["path"], b["content"], strict=True)], columns=names)

    return files.select("path", "content").mapInPandas(run, HEAD).withColumn("sections", section_list(F.col("full_content")))


def refreshed(files: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """As :func:`parsed`, and hash (12 digits of the content's MD5). Of earlier, a former result, a row is taken over where path
    and hash are the same; only other files are parsed. Files that are gone drop out; null content counts as empty."""
    now = files.select("path", "content", F.substring(F.md5(F.coalesce("content", F.lit("")).cast("binary")), 1, 12).alias("hash"))
    if earlier is None:
        fresh, kept = now, None
    else:
        fresh = now.join(earlier.select("path", "hash"), ["path", "hash"], "left_anti")
        kept = earlier.join(now.select("path", "hash"), ["path", "hash"], "left_semi")
    out = parsed(fresh).join(fresh.select("path", "hash"), "path")
    return out if kept is None else out.unionByName(kept)


def sections(files: DataFrame) -> DataFrame:
    """files (path, content) to one row per section, each with its document's priority and tags in lower case."""
    each = parsed(files).select("path", "priority", F.transform("tags", F.lower).alias("tags"), F.explode("sections").alias("s"))
    return each.select("path", "s.heading", "s.level", "s.content", F.transform("s.code_blocks", lambda c: c["code"]).alias("code_blocks"), "s.start_line", "priority", "tags")
