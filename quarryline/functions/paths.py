"""Path expressions: parts, globs, ignore rules, languages, resolution below a root."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that a project scan leaves out.
IGNORE_DIRS = (
    ".git .svn .hg node_modules venv .venv env .env __pycache__ .pytest_cache .mypy_cache vendor packages "
    "dist build .next .nuxt out target bin obj .idea .vscode .vs"
).split()

# File names that a project scan leaves out.
IGNORE_FILES = (
    "*.pyc *.pyo *.so *.dylib *.egg-info *.egg .DS_Store Thumbs.db *.min.js *.min.css *.lock *.log "
    "package-lock.json yarn.lock pnpm-lock.yaml"
).split()

# What a context scan leaves out, as directories or files.
IGNORE_ANY = [*IGNORE_DIRS, *"*.pyc *.pyo *.so *.dylib *.egg-info *.egg .DS_Store Thumbs.db".split()]

# Extensions that are indexed.
INDEXED = ".py .pyw .js .jsx .ts .tsx .mjs .cjs .json .yaml .yml .toml .sql .md .txt".split()

# Extensions whose files are read as context.
READABLE = (
    ".py .js .ts .jsx .tsx .java .kt .scala .go .rs .c .cpp .h .hpp .rb .php .swift .m .html .css .scss .sass .less "
    ".json .yaml .yml .toml .md .txt .rst .sql .sh .bash .zsh .vue .svelte .xml .gradle"
).split()

# Extensions and names of configuration files in a project's root, and lock files that don't count.
CONFIG_EXTENSIONS = ".json .toml .yaml .yml .lock".split()
CONFIG_NAMES = "Dockerfile Makefile Gemfile Procfile requirements.txt setup.py setup.cfg .gitignore .env.example".split()
LOCK_FILES = "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock Cargo.lock composer.lock".split()

# Names of files that speak for a project, by suffix of the path.
KEY_FILES = (
    "package.json pyproject.toml requirements.txt tsconfig.json vite.config.ts next.config.js README.md src/App.tsx "
    "src/main.tsx src/index.ts app.py main.py __init__.py"
).split()

# Stems of entry points, and extensions that count more.
ENTRY_POINTS = "main app index server cli __init__".split()
CODE_BONUS = ".py .js .ts .tsx .jsx".split()
DATA_BONUS = ".json .yaml .yml .toml".split()

# Language by extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".jsx": "jsx", ".json": "json", ".yaml": "yaml",
    ".yml": "yaml", ".md": "markdown", ".html": "html", ".css": "css", ".scss": "scss", ".sh": "bash", ".bash": "bash",
    ".zsh": "bash", ".rs": "rust", ".go": "go", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
    ".rb": "ruby", ".php": "php", ".sql": "sql", ".toml": "toml", ".xml": "xml", ".vue": "vue", ".svelte": "svelte",
}

# Names for what is shown before it is approved.
SHOWN_LANGUAGES = {k: v for k, v in LANGUAGES.items() if k not in (".php", ".toml", ".xml", ".vue", ".svelte")} | {".kt": "kotlin", ".swift": "swift"}


def glob(pattern: str) -> str:
    """A shell pattern as an anchored regular expression that the JVM understands."""
    return "^" + re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"(?s:\1)$", fnmatch.translate(pattern))


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last extension with its dot, empty if none; a leading dot doesn't begin one."""
    return F.regexp_extract(name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def parents(path: Column) -> Column:
    """Names of the directories above the file, outermost first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def matches_any(value: Column, patterns: list[str]) -> Column:
    """Whether one of the shell patterns matches the whole value; plain names go into one set test."""
    plain = [p for p in patterns if not set("*?[") & set(p)]
    out = value.isin(*plain) if plain else F.lit(False)
    for p in patterns:
        if p not in plain:
            out = out | value.rlike(glob(p))
    return out


def ignored_exact(path: Column, dirs: list[str] = IGNORE_DIRS, files: list[str] = IGNORE_FILES) -> Column:
    """A directory has one of the names, or the file's name matches."""
    return F.exists(parents(path), lambda d: d.isin(*dirs)) | matches_any(name(path), files)


def ignored_any(path: Column, patterns: list[str] = IGNORE_ANY) -> Column:
    """Any part of the path, file or directory, matches."""
    return F.exists(F.split(path, "/"), lambda d: matches_any(d, patterns))


def ignored_substring(path: Column, patterns: list[str] = IGNORE_ANY) -> Column:
    """Plain patterns anywhere in the path, globs against the name."""
    out = F.lit(False)
    for p in patterns:
        out = out | (matches_any(name(path), [p]) if set("*?[") & set(p) else path.contains(p))
    return out


def language(path: Column, names: dict[str, str] = LANGUAGES) -> Column:
    ext, known = F.lower(suffix(path)), F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ext), F.lit("text"))


def resolved(path: Column) -> Column:
    """A relative path without '.', '..' and empty parts; null if it leaves the root or is absolute."""
    step = lambda acc, x: (
        F.when(acc.isNull() | x.isin("", "."), acc)
        .when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
        .otherwise(F.concat(acc, F.array(x)))
    )
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~path.startswith("/"), F.array_join(kept, "/"))
