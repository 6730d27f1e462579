"""Recorded event streams as a Spark data source, in batch and as a stream: ``spark.read.format("records").load(folder)``.

Each file in the folder (or below it) is what one job's connection has brought so far, and may grow. A row is one record:
``job`` (the file's path in the folder), ``position`` (byte offset of its first line), ``event`` and ``data``.

Option ``mode``:

* ``sse`` (the default): records of ``event:`` and ``data:`` lines that a blank line ends. A record needs both; several data
  lines are joined by line breaks.
* ``data``: each line that starts with ``data: `` is a record without an event.
* ``lines``: each line that isn't blank is a record without an event, as messages of a socket are.

In the first two a file may start with the head of an HTTP response. A state other than 200 is one row with the event
``error`` and a message, with what was read of the body together with the head. Bytes that aren't UTF-8 come out as U+FFFD; a
file of another kind gives no rows.

As a stream, offsets are each file's bytes up to the end of its last whole record. A query that restarts goes on from there,
so that a job which is resumed loses and repeats nothing. A file named like another with ``.end`` added says that the other is
complete; only then, and in a batch read, does a last record that no blank line has ended count. Option ``archive`` names a
folder outside the one read, where complete files are moved once their rows are committed; so offsets hold the open jobs only.

Files are read in ranges of ``split`` bytes (32 MB unless given). A record belongs to the range with its first byte, and the
reader of a range goes on to the end of its last record, so one very long job is many tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .tree import _open

SCHEMA = "job string, position long, event string, data string"
SPLIT, TAIL, BATCH_ROWS = 32 << 20, 64 << 10, 5000
#: What ends a piece of a file: a record never goes over it.
_ENDS = {"sse": re.compile(rb"(?<=\n)\r?\n"), "data": re.compile(rb"\n"), "lines": re.compile(rb"\n")}
#: Bytes before a range in which an end of a piece may begin.
_BACK = 3
_STATUS = re.compile(r"HTTP/\S+ +(\d+)")


@dataclass
class Range(InputPartition):
    job: str
    start: int
    stop: int
    low: int
    high: int
    """Bytes [start, stop) of those from low to high that are read together."""


def parse(piece: bytes, at: int, mode: str) -> Iterator[tuple[int, str | None, str]]:
    """(position, event, data) of the records of a piece that begins at byte ``at`` of its file. A record that nothing ends
    counts at the piece's end."""
    first, event, data = None, None, []
    lines = piece.split(b"\n")
    if at == 0 and mode != "lines" and (status := _STATUS.match(lines[0].decode("utf-8", "replace"))) and status[1] != "200":
        body = re.split(rb"\r?\n\r?\n", piece, maxsplit=1)[1:]
        said = "Authentication failed" if status[1] == "401" else f"Request failed: {status[1]} - " + b"".join(body).decode("utf-8", "replace")
        yield 0, "error", json.dumps({"message": said}, ensure_ascii=False)
        return
    for raw in [*lines, b""]:
        own, line = at, raw.decode("utf-8", "replace").strip()
        at += len(raw) + 1
        if mode == "lines":
            if line:
                yield own, None, line
        elif mode == "data":
            if line.startswith("data: "):
                yield own, None, line[6:]
        elif not line:
            if event and data:
                yield first, event, "\n".join(data)
            first, event, data = None, None, []
        elif line.startswith(("event:", "data:")):
            first = own if first is None else first
            name, _, value = line.partition(":")
            if name == "event":
                event = value.strip()
            else:
                data.append(value.strip())


class _Files:
    """What both readers share."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.mode = options.get("mode", "sse")
        self.split = int(options.get("split", SPLIT))
        self.archive = options.get("archive")
        if self.mode not in _ENDS or self.split < 1:
            raise ValueError("mode is sse, data or lines, and split at least 1")

    def sizes(self) -> tuple[dict[str, int], set[str]]:
        """Bytes of each file, and which files are complete. Names with a leading dot or underscore are passed over."""
        from pyarrow import fs

        system, root = _open(self.root)
        found = {}
        for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            job = f.path[len(root.rstrip("/")) + 1 :]
            if f.is_file and not any(p.startswith((".", "_")) for p in job.split("/")):
                found[job] = f.size
        ended = {j.removesuffix(".end") for j in found if j.endswith(".end")}
        return {j: n for j, n in found.items() if not (j.endswith(".end") and j.removesuffix(".end") in found)}, ended & found.keys()

    def whole(self, job: str, size: int) -> int:
        """Bytes up to the end of the last whole record, looked for from the end."""
        system, root = _open(self.root)
        with system.open_input_file(f"{root}/{job}") as f:
            low, tail = size, b""
            while low > 0:
                step = min(TAIL, low)
                low -= step
                tail = f.read_at(step, low) + tail[:_BACK]
                last = None
                for last in _ENDS[self.mode].finditer(tail):
                    pass
                if last is not None:
                    return low + last.end()
        return 0

    def ranges(self, job: str, low: int, high: int) -> list[Range]:
        return [Range(job, a, min(a + self.split, high), low, high) for a in range(low, high, self.split)]

    def rows(self, r: Range) -> Iterator[pa.RecordBatch]:
        system, root = _open(self.root)
        ends = _ENDS[self.mode]
        lead = max(r.low, r.start - _BACK)
        with system.open_input_file(f"{root}/{r.job}") as f:
            held = bytearray(f.read_at(r.stop - lead, lead))

            def from_here(place: int) -> int | None:
                """The first start of a piece at byte ``place`` or later, among the bytes held."""
                for m in ends.finditer(held, max(0, place - lead - _BACK)):
                    if lead + m.end() >= place:
                        return lead + m.end()
                return None

            a = r.low if r.start == r.low else from_here(r.start)
            if a is None or a >= r.stop:  # no record begins in the range
                return
            b = r.high if r.stop == r.high else from_here(r.stop)
            while b is None:
                more = f.read_at(min(TAIL, r.high - lead - len(held)), lead + len(held))
                if not more:
                    b = r.high
                    break
                seen = lead + len(held)
                held += more
                b = from_here(max(r.stop, seen - _BACK))
        out: list[tuple] = []
        for position, event, data in parse(bytes(held[a - lead : b - lead]), a, self.mode):
            out.append((r.job, position, event, data))
            if len(out) == BATCH_ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["job", "position", "event", "data"])


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self) -> list[Range]:
        return [r for job, size in sorted(self.files.sizes()[0].items()) for r in self.files.ranges(job, 0, size)] or [Range("", 0, 0, 0, 0)]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        return self.files.rows(r) if r.job else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = _Files(options)
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        sizes, ended = self.files.sizes()
        for job, size in sizes.items():
            if job in ended:
                self.known[job] = (size, size)
            elif self.known.get(job, (-1, 0))[0] != size:
                self.known[job] = (size, self.files.whole(job, size))
        self.known = {job: self.known[job] for job in sizes}
        return {job: upto for job, (_, upto) in sorted(self.known.items())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for job, upto in end.items() if upto > start.get(job, 0) for r in self.files.ranges(job, start.get(job, 0), upto)]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        return self.files.rows(r)

    def commit(self, end: dict) -> None:
        if self.files.archive is None:
            return
        system, root = _open(self.files.root)
        _, archive = _open(self.files.archive)
        sizes, ended = self.files.sizes()
        for job in ended:
            if end.get(job) == sizes[job]:
                target = f"{archive}/{job}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                system.move(f"{root}/{job}", target)
                system.delete_file(f"{root}/{job}.end")


class Records(DataSource):
    """Registered by :func:`register`; see the module for options."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(Records)
