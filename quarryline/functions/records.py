"""Expressions over messages in JSON: records, changes, human-readable content, tool descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANGE = "struct<type: string, path: string, content: string, search: string, replace: string, description: string>"


def _get(raw: Column, *path: str) -> Column:
    return F.get_json_object(raw, "$." + ".".join(path))


def message(raw: Column, types: list[str]) -> Column:
    """struct(type, data, call_id, request_id): an unknown type is 'error'; without data the whole message is the data."""
    kind = _get(raw, "type")
    return F.struct(
        F.when(kind.isin(*types), kind).otherwise("error").alias("type"),
        F.coalesce(_get(raw, "data"), raw).alias("data"),
        F.coalesce(_get(raw, "call_id"), _get(raw, "data", "call_id")).alias("call_id"),
        F.coalesce(_get(raw, "request_id"), _get(raw, "data", "request_id")).alias("request_id"),
    )


def typed(event: Column, data: Column, known: list[str]) -> Column:
    """struct(type, data) of a record: an unknown event, or none, is 'error'; data that isn't JSON becomes {"message": data}."""
    kind = F.when(event.isin(*known), event).otherwise("error")
    return F.struct(kind.alias("type"), F.when(F.try_parse_json(data).isNull(), F.to_json(F.struct(data.alias("message")))).otherwise(data).alias("data"))


def change(raw: Column) -> Column:
    """A file change; type, path and description are empty where they are missing."""
    c = F.from_json(raw, CHANGE)
    empty = [F.coalesce(c[x], F.lit("")).alias(x) for x in ("type", "path")]
    return F.struct(*empty, *[c[x].alias(x) for x in ("content", "search", "replace")], F.coalesce(c["description"], F.lit("")).alias("description"))


def readable(raw: Column) -> Column:
    """What a person should read of a message: its summary, text, payload's message, message or content, else all of it."""
    text = _get(raw, "text")
    return F.coalesce(
        _get(raw, "human_readable_summary"), _get(text, "human_readable_summary"), _get(text, "text"), _get(text, "message"), text,
        _get(raw, "payload", "message"), _get(raw, "message"), _get(raw, "content"), raw,
    )


def worker(text: Column) -> Column:
    """The name in brackets at the start of a message; empty if none."""
    return F.regexp_extract(text, r"^\[([^\]]*)\]", 1)


def action(text: Column) -> Column:
    """What follows '[worker] '; null for notices of a tool or a numbered step."""
    rest = F.regexp_replace(text, r"^\[[^\]]*\].?", "")
    return F.when(~F.trim(rest).startswith("Using ") & ~rest.startswith("Step "), rest)


# How a tool call is announced, and the argument that is shown.
ANNOUNCED = {
    "read_file": ("Read file: ", "file_path", "?"),
    "write_file": ("Write file: ", "file_path", "?"),
    "edit_file": ("Edit file: ", "file_path", "?"),
    "delete_file": ("Delete file: ", "file_path", "?"),
    "shell": ("Run command: ", "command", "?"),
    "list_files": ("List files: ", "path", "."),
    "search_files": ("Search files: ", "pattern", "?"),
    "search_code": ("Search code index: ", "query", "?"),
}


def announced(tool: Column, args: Column) -> Column:
    out = F.concat(tool, F.lit(": "), args)
    for name, (words, key, missing) in ANNOUNCED.items():
        out = F.when(tool == name, F.concat(F.lit(words), F.coalesce(_get(args, key), F.lit(missing)))).otherwise(out)
    return out
