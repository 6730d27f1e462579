"""Chunks and symbols of source files, one batch of files at a time.

Python is parsed with the standard library's ast; a file that it rejects, or of another kind, becomes one module chunk
with its first 200 lines. Decorated definitions count like bare ones, and text is cut by character. A Python file's imports
are a module row without content, which isn't text to be searched.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame

from .lexer import closing, script_code, split_top, sql_code, sql_statements

MAX_BYTES = 100 * 1024
MODULE_LINES = 200
CHUNK = "id string, file string, type string, name string, signature string, content string, line_start int, line_end int, parent string, calls array<string>, imports array<string>"

_DDL = re.compile(r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:UNIQUE\s+|TEMP(?:ORARY)?\s+)?(TABLE|VIEW|FUNCTION|PROCEDURE|INDEX|TRIGGER)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)", re.I)
_JS = re.compile(r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:(?:async\s+)?function\s+(\w+)|class\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)", re.M)


def _row(file, kind, name, signature, content, start, end, parent=None, calls=(), imports=(), key=None):
    return {"id": f"{file}:{key or name}", "file": file, "type": kind, "name": name, "signature": signature, "content": content, "line_start": start, "line_end": end, "parent": parent, "calls": sorted(set(calls)), "imports": list(imports)}


def _calls(node: ast.AST) -> list[str]:
    return [getattr(n.func, "attr", None) or getattr(n.func, "id", "") for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))]


def module_imports(tree: ast.Module) -> list[str]:
    """Names of imported modules outside function and class bodies; an import under another name isn't counted."""
    todo, out = [tree], []
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Import):
            out += [(n.lineno, a.name) for a in n.names if not a.asname]
        elif isinstance(n, ast.ImportFrom):
            out.append((n.lineno, "." * n.level + (n.module or "")))
        todo += [c for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    return [name for _, name in sorted(out, key=lambda x: x[0])]


def python_chunks(file: str, text: str) -> list[dict]:
    lines, out = text.split("\n"), []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def cut(n):
        return "\n".join(lines[n.lineno - 1 : n.end_lineno])

    def classes(body, parent):
        for n in body:
            if isinstance(n, functions):
                kind, key = ("method", f"{parent}.{n.name}") if parent else ("function", n.name)
                out.append(_row(file, kind, n.name, lines[n.lineno - 1].strip(), cut(n), n.lineno, n.end_lineno, parent, _calls(n), key=key))
            elif isinstance(n, ast.ClassDef):
                doc = ast.get_docstring(n)
                methods = [f"    {lines[m.lineno - 1].strip()}\n        ..." for m in n.body if isinstance(m, functions)]
                summary = "\n".join([lines[n.lineno - 1], *([f'    """{doc}"""'] if doc else []), *methods])
                out.append(_row(file, "class", n.name, lines[n.lineno - 1].strip(), summary, n.lineno, n.end_lineno, parent, imports=[b.id if isinstance(b, ast.Name) else b.attr for b in n.bases if isinstance(b, (ast.Name, ast.Attribute))]))
                classes(n.body, n.name)

    tree = ast.parse(text)
    classes(tree.body, None)
    if imports := module_imports(tree):
        out = out or [module_chunk(file, text)]
        if out[0]["type"] == "module":
            out[0]["imports"] = imports
        else:
            out.append(_row(file, "module", PurePosixPath(file).stem, f"# {file}", None, 1, 1, imports=imports, key="module"))
    return out


#: What begins an entry of a table's list that isn't a column.
_CONSTRAINT = re.compile(r"(?:CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK|EXCLUDE|KEY|INDEX|LIKE)\b", re.I)
_COLUMN = re.compile(r"\"[^\"]+\"|`[^`]+`|\w+")
_REFERRED = re.compile(r"\b(?:FROM|JOIN|ON|REFERENCES|INTO|UPDATE)\s+([A-Za-z_\"][\w.\"]*)", re.I)
#: Words that stand where a table's name could.
_NOT_TABLES = {"select", "delete", "update", "insert", "conflict", "cascade", "commit", "set", "each", "lateral", "only"}
SHOWN_COLUMNS = 5


def table_columns(code: str, at: int) -> list[str]:
    """The column names in the list that opens at the first bracket from ``at`` on."""
    opening = code.find("(", at)
    if opening < 0:
        return []
    parts = [code[x:y].strip() for x, y in split_top(code, opening + 1, closing(code, opening) - 1)]
    return [_COLUMN.match(p)[0].strip('"`') for p in parts if _COLUMN.match(p) and not _CONSTRAINT.match(p)]


def sql_chunks(file: str, text: str) -> list[dict]:
    """A chunk for each CREATE statement. A table's signature shows its first columns; what a body in dollar quotes refers to
    counts like what stands outside."""
    code, out = sql_code(text), []
    for begin, end in sql_statements(code):
        m = _DDL.search(code, begin, end)
        if not m:
            continue
        kind, name = m[1].lower(), m[2].replace('"', "")
        body = text[m.start() : end].strip()
        start = text.count("\n", 0, m.start()) + 1
        signature = body.split("\n")[0]
        if kind == "table":
            columns = table_columns(code[:end], m.end())
            signature = f"CREATE TABLE {name}" + (f" ({', '.join(columns[:SHOWN_COLUMNS])}{'...' if len(columns) > SHOWN_COLUMNS else ''})" if columns else "")
        inside = "\n".join([code[m.end() : end], *(sql_code(x[2]) for x in re.finditer(r"\$(\w*)\$(.*?)\$\1\$", text[m.start() : end], re.S))])
        refs = {r.replace('"', "") for r in _REFERRED.findall(inside)}
        refs = {r for r in refs if r != name and r.lower() not in _NOT_TABLES}
        out.append(_row(file, kind, name, signature, body, start, start + body.count("\n"), imports=sorted(refs), key=f"{kind}:{name}"))
    return out


_BODY = re.compile(r"\s*\{")
_CALL = re.compile(r"(\w+)\s*\(")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "super"}


def _expression_end(code: str, at: int) -> int:
    """Where an expression that begins after ``at`` ends: at a semicolon or line break outside brackets, or at a bracket
    that closes one around it."""
    depth, begun = 0, False
    for m in re.compile(r"\S|\n").finditer(code, at):
        c = m[0]
        if depth == 0 and (c == ";" or c == "\n" and begun or c in ")]}"):
            return m.start()
        depth += (c in "([{") - (c in ")]}")
        begun = begun or c != "\n"
    return len(code)


def _body_at(code: str, m: re.Match) -> int:
    """Where the brace of a function's or class's body stands, behind its parameters and their types; -1 without one."""
    at = m.end()
    if m[1]:
        opening = code.find("(", at)
        at = closing(code, opening) if opening >= 0 else at
    return code.find("{", at)


def script_chunks(file: str, text: str) -> list[dict]:
    """A chunk for each function, class and arrow function that is named. Braces in strings, templates, patterns and comments
    don't count, and no calls are found there but in what a template holds in ``${}``."""
    code, out = script_code(text), []
    for m in _JS.finditer(code):
        name, kind = next((n, k) for n, k in zip(m.groups(), ("function", "class", "function"), strict=True) if n)
        braced = _BODY.match(code, m.end()) if m[3] else None
        opening = braced.end() - 1 if braced else -1 if m[3] else _body_at(code, m)
        end = closing(code, opening) if opening >= 0 else _expression_end(code, m.end())
        body = text[m.start() : end].strip()
        start = text.count("\n", 0, m.end()) + 1
        head = text[m.start() : opening if opening >= 0 else m.end()].strip()
        signature = head if opening >= 0 else body.split("{")[0].strip()
        calls = [c for c in _CALL.findall(code[m.end() if m[1] or m[3] else opening : end]) if c not in _NOT_CALLS]
        out.append(_row(file, kind, name, signature, body, start, start + body.count("\n"), calls=[] if kind == "class" else calls))
    return out


def module_chunk(file: str, text: str) -> dict:
    lines = text.split("\n")
    content = "\n".join(lines[:MODULE_LINES]) + ("\n... (truncated)" if len(lines) > MODULE_LINES else "")
    return _row(file, "module", PurePosixPath(file).stem, lines[0], content, 1, len(lines), key="module")


def chunks_of(file: str, text: str | None) -> list[dict]:
    """No rows for a null or very large file."""
    if text is None or len(text.encode()) > MAX_BYTES:
        return []
    parser = {".py": python_chunks, ".pyw": python_chunks, ".sql": sql_chunks, **dict.fromkeys((".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), script_chunks)}.get(PurePosixPath(file).suffix.lower())
    try:
        return (parser(file, text) if parser else []) or [module_chunk(file, text)]
    except (SyntaxError, ValueError):
        return [module_chunk(file, text)]


#: Files that are parsed before their chunks leave the Python worker.
AT_ONCE = 100


def chunk_files(files: DataFrame) -> DataFrame:
    """files (path, content) to chunks. They come and go in small batches, so that a worker's memory doesn't follow the size of
    a partition."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        for b in batches:
            for i in range(0, len(b), AT_ONCE):
                own = b.iloc[i : i + AT_ONCE]
                yield pd.DataFrame([r for p, c in zip(own["path"], own["content"], strict=True) for r in chunks_of(p, c)], columns=names)

    return files.select("path", "content").mapInPandas(run, CHUNK)
