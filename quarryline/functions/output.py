"""Output of shell commands and tools: noise filters, length limits and tags by what was run and whether it succeeded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import command_class, smart_truncate

# By command class, the characters kept on success and on failure.
LIMITS = {"install": (500, 2000), "run": (4000, 8000), "test": (2000, 8000), "build": (1000, 6000), "default": (3000, 6000)}

# By command class, the patterns of lines that are noise.
NOISE = {
    "install": (
        r"Collecting \S+", r"Downloading \S+", r"Installing collected", r"Successfully installed", r"━+", r"[\s]*\d+%[\s]*\|",
        r"Using cached", r"Requirement already satisfied", r"added \d+ packages", r"up to date", r"npm WARN",
    ),
    "test": (r"^\.+$", r"^PASSED", r"^\s*✓"),
    "build": (r"Compiling \S+", r"Finished \S+ target"),
}

# By command class, what keeps a line whatever its case.
KEPT = {
    "install": ("error", "Error", "ERROR", "failed", "Failed", "FAILED", "warning:", "Warning:"),
    "test": ("FAILED", "FAIL", "Error", "error", "AssertionError", "Expected", "Actual"),
    "build": ("error", "Error", "ERROR", "warning", "Warning"),
}

# Priorities of outputs, by command class and by tool; others have 50, and a failure has 20 more.
COMMAND_PRIORITY = {"run": 80, "test": 70, "build": 60, "install": 30}
TOOL_PRIORITY = {"read_file": 80, "search_code": 75, "search_files": 70, "list_files": 60, "write_file": 30, "edit_file": 30}


def _by(key: Column, values: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def kept_lines(lines: Column, kind: Column) -> Column:
    """The lines of an output without blank ones and, by command class, without noise; what names an error stays."""
    out = F.filter(lines, lambda x: x.rlike(r"(?U)\S"))
    by = out
    for name in NOISE:
        noise, keep = "|".join(f"(?:{p})" for p in NOISE[name]), "(?i)" + "|".join(dict.fromkeys(k.lower() for k in KEPT[name]))
        by = F.when(kind == name, F.filter(out, _stays(noise, keep))).otherwise(by)
    return by


def _stays(noise: str, keep: str):
    return lambda x: x.rlike(keep) | ~x.rlike(noise)


def shell_output(output: Column, command: Column, success: Column) -> Column:
    """struct(output, command_type, original_lines, filtered_lines, truncated, limit_applied): noise filtered, then cut at
    the limit of the command's class, at a line break where one lies beyond 80 % of it. Null output is empty."""
    text = F.regexp_replace(F.coalesce(output, F.lit("")), r"\r\n?", "\n")
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))
    kind = command_class(F.coalesce(command, F.lit("")))
    kept = kept_lines(lines, kind)
    joined = F.array_join(kept, "\n")
    limits = {k: F.when(success, ok).otherwise(bad) for k, (ok, bad) in LIMITS.items()}
    limit = _by(kind, {k: v for k, v in limits.items() if k != "default"}, 0)
    limit = F.when(limit == 0, limits["default"]).otherwise(limit)
    return F.struct(
        smart_truncate(joined, limit).alias("output"), kind.alias("command_type"), F.size(lines).alias("original_lines"),
        F.size(kept).alias("filtered_lines"), (F.length(joined) > limit).alias("truncated"), limit.alias("limit_applied"),
    )


def tag(tool: Column, command: Column, success: Column, error: Column) -> Column:
    """struct(tool, success, output_type, priority): a result with an error has failed, one that doesn't say has not."""
    good = F.coalesce(success, F.lit(True)) & error.isNull()
    kind = command_class(F.coalesce(command, F.lit("")))
    base = F.when(tool == "shell", _by(kind, COMMAND_PRIORITY, 50)).otherwise(_by(tool, TOOL_PRIORITY, 50))
    return F.struct(
        tool.alias("tool"), good.alias("success"), F.when(tool == "shell", F.concat(F.lit("shell_"), kind)).otherwise(tool).alias("output_type"),
        (base + F.when(good, 0).otherwise(20)).alias("priority"),
    )


def tool_result(tool: Column, known: list[str], result: Column, failure: Column) -> Column:
    """struct(result, error) of a tool's run: an unknown tool and a failure give an error and no result."""
    error = F.when(~F.coalesce(tool, F.lit("")).isin(*known), F.concat(F.lit("Unknown tool: "), F.coalesce(tool, F.lit("")))).otherwise(failure)
    return F.struct(F.when(error.isNull(), result).alias("result"), error.alias("error"))
