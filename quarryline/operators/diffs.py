"""Differences of texts line by line, and applying them."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what follows a line that the text ends in without a line break.
NO_BREAK = "\\ No newline at end of file"
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _lines(text: str) -> list[str]:
    """Lines with their breaks; only line feeds end a line."""
    return re.findall(r"[^\n]*\n|[^\n]+\Z", text)


def unified(path: str, old: str, new: str) -> str:
    out = difflib.unified_diff(_lines(old), _lines(new), f"a/{path}", f"b/{path}")
    return "".join(x if x.endswith("\n") else f"{x}\n{NO_BREAK}\n" for x in out)


def apply_unified(text: str, diff: str) -> str:
    """The text after the hunks of a unified diff, each at its stated place. ValueError where a hunk is damaged, or a line that
    it keeps or removes isn't there."""
    old, out, at = _lines(text), [], 0
    rows = diff.split("\n")
    k = 0
    while k < len(rows):
        m = _HUNK.match(rows[k])
        k += 1
        if not m:
            continue
        n_old, n_new = (int(x) if x is not None else 1 for x in (m[2], m[4]))
        begin = int(m[1]) - (n_old > 0)
        if begin < at or begin > len(old):
            raise ValueError(f"hunk at line {m[1]} out of order or beyond the end")
        out += old[at:begin]
        at = begin
        while n_old or n_new:
            if k == len(rows) or rows[k][:1] not in (" ", "-", "+"):
                raise ValueError(f"hunk at line {m[1]} has too few lines")
            mark, line = rows[k][0], rows[k][1:]
            k += 1
            if k < len(rows) and rows[k].startswith("\\"):
                k += 1
            else:
                line += "\n"
            if mark != "+":
                if at == len(old) or old[at] != line or not n_old:
                    raise ValueError(f"line {at + 1} is not as the hunk at line {m[1]} says")
                at += 1
                n_old -= 1
            if mark != "-":
                if not n_new:
                    raise ValueError(f"hunk at line {m[1]} has too many lines")
                out.append(line)
                n_new -= 1
    return "".join(out + old[at:])


def unified_diff(pairs: DataFrame) -> DataFrame:
    """pairs (path, old, new) to (path, diff); null counts as empty. A last line without a break is marked as such."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["path"], b["old"].fillna(""), b["new"].fillna(""), strict=True)
            yield pd.DataFrame([(p, unified(p, o, n)) for p, o, n in rows], columns=["path", "diff"])

    return pairs.select("path", "old", "new").mapInPandas(run, "path string, diff string")


def inline_diff(pairs: DataFrame) -> DataFrame:
    """pairs (path, old, new) to (path, position, mark, line): all lines of both, those of the old text marked - and of the new
    one +, common ones with a blank; removed lines come before those in their place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, o, n in zip(batch["path"], batch["old"].fillna(""), batch["new"].fillna(""), strict=True):
                old, new, k = o.split("\n"), n.split("\n"), 0
                for tag, a, b, c, d in difflib.SequenceMatcher(None, old, new).get_opcodes():
                    for mark, lines in ((" ", old[a:b]),) if tag == "equal" else (("-", old[a:b]), ("+", new[c:d])):
                        for x in lines:
                            out.append((p, k, mark, x))
                            k += 1
            yield pd.DataFrame(out, columns=["path", "position", "mark", "line"])

    return pairs.select("path", "old", "new").mapInPandas(run, "path string, position int, mark string, line string")


def apply_diffs(files: DataFrame, diffs: DataFrame) -> DataFrame:
    """files (path, content) with diffs (path, diff), one for each path, to (path, content, error). A missing file counts as
    empty where the diff only adds. A diff that doesn't fit leaves the content as it was, with an error; files without a
    diff stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content, diff in zip(b["path"], b["content"], b["diff"], strict=True):
                try:
                    out.append((path, content if diff is None else apply_unified(content or "", diff), None))
                except ValueError as e:
                    out.append((path, content, str(e)))
            yield pd.DataFrame(out, columns=["path", "content", "error"])

    both = files.select("path", "content").join(diffs.select("path", "diff"), "path", "full_outer")
    return both.select("path", "content", "diff").mapInPandas(run, "path string, content string, error string")


def expired(backups: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """backups (path, modified) that are older than so many hours."""
    return backups.where(F.unix_millis("modified") < F.unix_millis(now) - F.lit(int(hours * 3_600_000)))
