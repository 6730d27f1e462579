"""WARC archives: records written as one gzip member each, read back sequentially.

The reader decompresses incrementally (a window of bytes at a time, a new zlib stream for each member), frames blocks by
Content-Length and verifies the digests of block and payload. Of records with equal payloads one is a response; the
others are revisits, which hold the HTTP head only and refer to it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, shared_path, small_batches, task_name, written

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
READ_BYTES = 1 << 16
#: A task starts a new archive beyond this.
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers (lower-case names) and payload."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return dict(_fields(head.split(b"\r\n")[1:])), payload


def _fields(lines: list[bytes]) -> Iterator[tuple[str, str]]:
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        yield name.strip().lower(), value.strip()


def record_bytes(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record as a gzip member. A revisit's block ends after the HTTP head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    url = "".join((url or "urn:unknown").split()) or "urn:unknown"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    zip_ = zlib.compressobj(4, zlib.DEFLATED, 31)
    return zip_.compress(data) + zip_.flush()


class _Stream:
    """The bytes of one gzip member after the other, decompressed as they are asked for."""

    def __init__(self, file, size: int = READ_BYTES):
        self.file, self.size = file, size
        self.raw, self.out = b"", bytearray()
        self.zip = None
        self.ended = False

    def _more(self) -> bool:
        """Decompresses some; False where the member is over."""
        if self.zip is None or self.zip.eof:
            return False
        data = self.raw or self.file.read(self.size)
        self.raw = b""
        if not data:
            raise ValueError("archive ends within a record")
        try:
            self.out += self.zip.decompress(data, 1 << 20)
        except zlib.error as e:
            raise ValueError(f"damaged compression: {e}") from None
        self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
        return True

    def next_member(self) -> bool:
        while not self.zip_over():
            self._more()
        if self.out:
            raise ValueError("bytes after the record")
        self.raw = self.raw or self.file.read(self.size)
        self.zip = zlib.decompressobj(31) if self.raw else None
        return self.zip is not None

    def zip_over(self) -> bool:
        return self.zip is None or self.zip.eof

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.out.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.out)
            if not self._more():
                raise ValueError("record without end of headers")
        data = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return data

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise ValueError("record shorter than its Content-Length")
        data = bytes(self.out[:n])
        del self.out[:n]
        return data


def read_records(file, verify: bool = True) -> Iterator[Record]:
    """The records of an archive in order. ValueError for damage: framing, lengths or digests that don't hold."""
    stream = _Stream(file)
    while stream.next_member():
        lines = stream.until(b"\r\n\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(_fields(lines[1:]))
        length = headers.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise ValueError("record without a valid Content-Length")
        record = Record(headers, stream.take(int(length)))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("record not closed")
        if verify:
            if "sha256:" + hashlib.sha256(record.block).hexdigest() != headers.get("warc-block-digest"):
                raise ValueError("block digest differs")
            if record.kind == "response" and record.http()[0].get("content-length") != str(len(record.http()[1])):
                raise ValueError("payload length differs")
            if record.kind == "response" and "sha256:" + hashlib.sha256(record.http()[1]).hexdigest() != headers.get("warc-payload-digest"):
                raise ValueError("payload digest differs")
        yield record


def _page_urn(page_id: int | None) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def _page_id(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").rpartition(":")[2]
    return int(value) if value else None


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html). Returns, written, one row per archive: path, records.

    Groups of equal payloads come from a partial aggregate over digests; rows find their group by a join that Spark
    can split where a group holds very many. Archives have names of their own, so a task that is run again leaves at
    most a file that no row names.
    """
    small_batches(pages.sparkSession, 500)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    keys = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = written(keys.where("n > 1 and first is not null").select("digest", "first"), "equal-payloads")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = rows.join(groups, "digest", "left").select("page_id", "url", F.col("payload"), "digest", F.when(revisits, F.col("first")).alias("refers_to"), revisits.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = file_system(path)
        out, name, n, size, made = None, "", 0, 0, []
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(where, recursive=True)
                    name, n, size = f"{where}/{task_name()}.warc.gz", 0, 0
                    out = fs.open_output_stream(name)
                page, url, data, digest, to, again = x
                record = record_bytes("revisit" if again else "response", _page_urn(page), url, data, digest, _page_urn(to))
                out.write(record)
                n, size = n + 1, size + len(record)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    made.append((name, n))
        if out is not None:
            out.close()
            made.append((name, n))
        if made:
            yield pa.RecordBatch.from_pydict({"path": [m[0] for m in made], "records": [m[1] for m in made]})

    return written(marked.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to. A task reads an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(root)
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, count = [], 0
                with fs.open_input_stream(path) as f:
                    for r in read_records(f):
                        head, _ = r.http()
                        count += 1
                        rows.append((_page_id(r.headers["warc-record-id"]), r.headers["warc-target-uri"], int(head["content-length"]), r.headers["warc-payload-digest"].removeprefix("sha256:"), r.kind, _page_id(r.headers.get("warc-refers-to"))))
                        if len(rows) == 2000:
                            yield _batch(rows)
                            rows = []
                if count != records:
                    raise ValueError(f"{path}: {count} records of {records}")
                if rows:
                    yield _batch(rows)

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive_pages(pages: DataFrame) -> DataFrame:
    """One row per page, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least 100 bytes the smallest page_id is the response; rows that repeat that id are
    responses too. Null html is the empty payload. A null page_id revisits like any other id but is never referred to;
    a group of null ids only has no revisits. An empty table writes no archive and gives no rows.
    """
    path = shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, path), path).drop("url")
