"""What is code in a script or SQL text, and where its brackets close.

The text is copied with blanks for what isn't code: comments, strings, templates, patterns and dollar-quoted bodies, but for
line breaks. The copy is as long as the text, so places in it are places in the text.
"""

from __future__ import annotations

import re

_SCRIPT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|[`{}/]", re.S)
_TEMPLATE = re.compile(r"(?:\\.|(?!\$\{)[^`\\])*(`|\$\{|\Z)", re.S)
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: A slash after one of these begins a pattern; after others it divides.
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>\n]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do))[ \t]*\Z")
_SQL = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:''|[^'])*(?:'|\Z)|\$(\w*)\$.*?(?:\$\1\$|\Z)", re.S)
_SQL_WORD = re.compile(r"\b(BEGIN|CASE|END)\b(?!\s+(?:IF|LOOP|WHILE|REPEAT|FOR)\b)|;", re.I)
#: Statements whose body may hold other statements.
_WITH_BODY = re.compile(r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:DEFINER\s*=\s*\S+\s+)?(?:TEMP(?:ORARY)?\s+)?(?:TRIGGER|PROCEDURE|FUNCTION)\b", re.I)
_OPENING, _CLOSING = "([{", ")]}"


def _blank(part: str) -> str:
    return re.sub(r"[^\n]", " ", part)


def script_code(text: str) -> str:
    """JavaScript or TypeScript with blanks for all but code. What a template holds in ``${}`` is code, templates in it are not."""
    out: list[str] = []
    at, depth = 0, 0
    templates: list[int] = []  # the depth of braces at which each open template goes on

    def template(start: int) -> int:
        nonlocal depth
        m = _TEMPLATE.match(text, start)
        out.append(_blank(text[start : m.start(1)]))
        if m[1] == "${":
            depth += 1
            templates.append(depth)
            out.append(" {")
        else:
            out.append(_blank(m[1]))
        return m.end()

    while m := _SCRIPT.search(text, at):
        out.append(text[at : m.start()])
        at, token = m.end(), m[0]
        if token == "`":
            out.append(" ")
            at = template(at)
        elif token == "{":
            depth += 1
            out.append(token)
        elif token == "}":
            out.append(token)
            if templates and templates[-1] == depth:
                templates.pop()
                depth -= 1
                at = template(at)
            else:
                depth = max(0, depth - 1)
        elif token == "/":
            before = "".join(out)[-40:] if len(out) < 8 else "".join(out[-8:])[-40:]
            pattern = _PATTERN.match(text, m.start()) if _BEFORE_PATTERN.search(before) else None
            out.append(_blank(pattern[0]) if pattern else token)
            at = pattern.end() if pattern else at
        else:
            out.append(_blank(token))
    return "".join(out) + text[at:]


def sql_code(text: str) -> str:
    """SQL with blanks for all but code; names in double quotes are code."""
    return _SQL.sub(lambda m: _blank(m[0]), text)


def sql_statements(code: str) -> list[tuple[int, int]]:
    """(from, to) of the statements of code without strings: they end at semicolons, but not at those in the blocks of
    triggers, procedures and functions."""
    out, start, depth = [], 0, 0
    body = bool(_WITH_BODY.match(code, 0))
    for m in _SQL_WORD.finditer(code):
        if m[1]:
            if body:
                depth = max(0, depth + (1 if m[1].upper() != "END" else -1))
        elif depth == 0:
            out.append((start, m.end()))
            start = m.end()
            body = bool(_WITH_BODY.match(code, start))
    if code[start:].strip():
        out.append((start, len(code)))
    return out


def closing(code: str, at: int) -> int:
    """Behind the bracket that closes the one at ``at``, whatever kinds lie between; the text's end if none does."""
    open_: list[str] = []
    for m in re.compile(r"[()\[\]{}]").finditer(code, at):
        if m[0] in _OPENING:
            open_.append(_CLOSING[_OPENING.index(m[0])])
        elif m[0] in open_:
            while open_.pop() != m[0]:
                pass
            if not open_:
                return m.end()
    return len(code)


def split_top(code: str, start: int, end: int) -> list[tuple[int, int]]:
    """The parts between commas outside brackets."""
    out, at, depth = [], start, 0
    for m in re.compile(r"[()\[\]{},]").finditer(code, start, end):
        if m[0] == ",":
            if depth == 0:
                out.append((at, m.start()))
                at = m.end()
        else:
            depth += 1 if m[0] in _OPENING else -1
    return [*out, (at, end)]
