"""A directory tree as rows, every entry of it: Spark's own file sources pass over empty files and names with a leading
dot or underscore, such as ``__init__.py``.

The tree is walked level by level. A level's directories are dealt to tasks that list them; what they hold is written, and the
directories in it are the next level, so the driver sees none of them and a lost executor costs its tasks only. One
directory's entries come from one task, in batches.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import IGNORE_DIRS
from ..operators.shared import written

#: Bytes of files that one task reads, bytes and rows of a batch.
TASK_BYTES, BATCH_BYTES, BATCH_ROWS = 64 << 20, 8 << 20, 5000
#: Tasks a level's directories are dealt to, for each core.
TASKS_A_CORE = 4
ENTRY = "path string, kind string, linked boolean, size long, modified timestamp, created timestamp"
_TIME = pa.timestamp("us", "UTC")
_ENTRY = pa.schema([("path", pa.string()), ("kind", pa.string()), ("linked", pa.bool_()), ("size", pa.int64()), ("modified", _TIME), ("created", _TIME)])
_FILE = pa.schema([("path", pa.string()), ("content", pa.string()), ("size", pa.int64()), ("modified", _TIME)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _local(store, path: str) -> tuple[bool, datetime | None]:
    """Whether a local path is a link, and when its record last changed; other stores have no links and tell no such time."""
    if store.type_name != "local":
        return False, None
    return os.path.islink(path), datetime.fromtimestamp(os.stat(path).st_ctime, UTC)


def _listed(store, base: str, directory: str, skip: frozenset[str]) -> Iterator[tuple]:
    from pyarrow import fs

    for f in store.get_file_info(fs.FileSelector(f"{base}/{directory}".rstrip("/") or "/", allow_not_found=True)):
        is_dir = f.type == fs.FileType.Directory
        if is_dir and f.base_name in skip or f.type not in (fs.FileType.Directory, fs.FileType.File):
            continue
        path = f"{directory}/{f.base_name}".lstrip("/")
        linked, created = _local(store, f.path)
        yield path, "directory" if is_dir else "file", linked, None if is_dir else f.size, f.mtime, created


def read_entries(spark: SparkSession, root: str, skip: list[str] = IGNORE_DIRS) -> DataFrame:
    """(path below root, kind, linked, size, modified, created) of every file and directory outside skipped directories.
    Directories have no size; linked ones are listed, but not what is in them. A root that isn't there has no entries."""
    root, leave = root.rstrip("/") or "/", frozenset(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        held: list[tuple] = []
        for b in batches:
            for directory in b.column(0).to_pylist():
                for entry in _listed(store, base.rstrip("/"), directory, leave):
                    held.append(entry)
                    if len(held) == BATCH_ROWS:
                        yield _batch(held, _ENTRY)
                        held = []
        if held:
            yield _batch(held, _ENTRY)

    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    level, levels = spark.range(1).select(F.lit("").alias("path")), []
    while not levels or not level.isEmpty():
        levels.append(written((level.repartition(tasks, "path") if levels else level).mapInArrow(run, ENTRY), "entries"))
        level = levels[-1].where("kind = 'directory' and not linked").select("path")
    return reduce(DataFrame.unionAll, levels)


def read_tree(spark: SparkSession, root: str, skip: list[str] = IGNORE_DIRS) -> DataFrame:
    """(path below root, content, size, modified) of every file outside skipped directories; bytes that aren't UTF-8 are replaced."""
    root = root.rstrip("/") or "/"
    own = read_entries(spark, root, skip).where("kind = 'file'").select("path", "size", "modified")
    tasks = max(1, -(-(own.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES), min(TASKS_A_CORE * spark.sparkContext.defaultParallelism, own.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        for b in batches:
            held, size = [], 0
            for path, n, at in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    held.append((path, f.read().decode("utf-8", "replace"), n, at))
                size += n
                if size >= BATCH_BYTES:
                    yield _batch(held, _FILE)
                    held, size = [], 0
            if held:
                yield _batch(held, _FILE)

    return own.repartition(tasks, "path").mapInArrow(run, "path string, content string, size long, modified timestamp")
