"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending order of their key. Layout: data blocks; index (for each block its last
key, offset and size); Bloom filter of the keys; footer of fixed size. In a block, each entry stores how many bytes of its key
are shared with the entry before, the rest of the key, and the value. A key is looked up by the filter, a binary search
of the sparse index, and a scan of a block. The key is the id's 8 bytes in an order-preserving form; a null id has the
empty key and comes first. The value is the document's token ids, two or four bytes each, little-endian.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, shared_path, small_batches, task_name, written
from .encoder import Encoder

MAGIC = b"QLSST001"
BLOCK_BYTES = 1 << 18
#: A shard file holds about so much text at most.
SHARD_BYTES = 1 << 29
BLOOM_BITS = 10
BLOOM_HASHES = 7
#: offsets and sizes of index and filter, entries, ids, bytes of an id, hashes, magic
FOOTER = struct.Struct("<QQQQQQII8s")

END = 2
TOKENIZER = "word_bpe_49k.json"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Writes entries, which must come in ascending order of key; equal keys are allowed."""

    def __init__(self, out, width: int = 2, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.zip = zstandard.ZstdCompressor(level=1)
        self.at = self.entries = self.ids = 0
        self.block, self.size, self.last = [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys out of order")
        shared = len(os.path.commonprefix([key, self.last])) if self.block else 0
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += len(value) // self.width
        if self.size >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_bloom_places(k, bits, BLOOM_HASHES)] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.entries, self.ids, self.width, BLOOM_HASHES, MAGIC))


class Reader:
    """Reads a shard through a seekable file: entries in order, or the values of a key."""

    def __init__(self, file, size: int):
        self.file = file
        self.unzip = zstandard.ZstdDecompressor()
        index_at, index_n, bloom_at, bloom_n, self.entries, self.ids, self.width, self.hashes, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        data, at = self._at(index_at, index_n), 0
        self.last, self.blocks = [], []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.last.append(data[at : at + n])
            offset, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.blocks.append((offset, length))
        bloom = self._at(bloom_at, bloom_n)
        self.bits = struct.unpack("<Q", bloom[:8])[0]
        self.bloom = bloom[8:]

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        data = self._at(*self.blocks[i])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        data, at, key = self.unzip.decompress(data[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits, self.hashes))

    def get(self, key: bytes) -> list[bytes]:
        """The values of key, in the order written."""
        out: list[bytes] = []
        if not self.may_hold(key):
            return out
        for i in range(bisect_left(self.last, key), len(self.blocks)):
            for k, v in self.block(i):
                if k > key:
                    return out
                if k == key:
                    out.append(v)
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def write_shards(docs: DataFrame, path: str, encoder: Callable[[], Encoder], end: int = END, shards: int | None = None) -> DataFrame:
    """Writes the documents (doc_id, text) to shard files below path. Returns, written, one row for each file: path, bytes,
    first, last (ids), entries, ids.

    Texts are dealt by ranges of doc_id, and of a hash of the text where many rows share an id, and sorted within them:
    into ``shards`` files or, if it is None, at least one for SHARD_BYTES of text. A task's file has a name of its own, so
    a task that is run again leaves at most a file that no row names.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    dealt = rows.repartitionByRange(shards, "doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = writer = coder = None
        ids: list[int | None] = []
        fs, where = file_system(path)
        name = f"{where}/{task_name()}.sst"
        try:
            for b in batches:
                if writer is None:
                    coder = encoder()
                    fs.create_dir(where, recursive=True)
                    out = fs.open_output_stream(name)
                    writer = Writer(out, coder.width)
                    last = np.array([end], coder.dtype).tobytes()
                own = b.column(0).to_pylist()
                for i, v in zip(own, coder.encode(b.column(1).to_pylist()), strict=True):
                    writer.add(key_of(i), v + last)
                ids = [*(ids[:1] or own[:1]), own[-1]] if own else ids
            if writer is not None:
                writer.close()
        finally:
            if out is not None:
                out.close()
        if writer is not None:
            yield pa.RecordBatch.from_pylist([{"path": name, "bytes": fs.get_file_info(name).size, "first": ids[0], "last": ids[-1], "entries": writer.entries, "ids": writer.ids}], schema=_MANIFEST)

    done = dealt.sortWithinPartitions("doc_id", "h", "text").mapInArrow(run, "path string, bytes long, first long, last long, entries long, ids long")
    return written(done, "sst-manifest")


_MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("entries", pa.int64()), ("ids", pa.int64())])


def read_shards(manifest: DataFrame, root: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    A task reads a file block by block. start counts the ids of all documents before: sums over the manifest, which
    has a row for each file, then within the file.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy(F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).select("path", "bytes", "before")
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(root)
        for b in batches:
            for x in b.to_pylist():
                with fs.open_input_file(x["path"]) as f:
                    reader = Reader(f, x["bytes"])
                    at = x["before"]
                    for i in range(len(reader.blocks)):
                        rows = []
                        for key, value in reader.block(i):
                            ids = np.frombuffer(value, "<u2" if reader.width == 2 else "<u4")
                            rows.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            at += len(ids)
                        cols = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, root: str, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """The token ids of each of doc_ids, by binary search: of the files' ranges, then within a file."""
    files = sorted((r.asDict() for r in manifest.where(F.col("last").isNotNull()).collect()), key=lambda r: (r["last"], r["path"]))
    fs, _ = file_system(root)
    ends = [r["last"] for r in files]
    out: dict[int, list[list[int]]] = {}
    for i in doc_ids:
        out[i] = []
        for r in files[bisect_left(ends, i) :]:
            if r["first"] is not None and r["first"] > i:
                break
            with fs.open_input_file(r["path"]) as f:
                reader = Reader(f, r["bytes"])
                out[i] += [np.frombuffer(v, "<u2" if reader.width == 2 else "<u4").tolist() for v in reader.get(key_of(i))]
    return out


def token_shards(docs: DataFrame, tokenizer: str | None = None, end: int = END, shards: int | None = None) -> DataFrame:
    """One row per document, read back from the shard files: doc_id, start, n_tokens, ids_crc32.

    A null text is empty and has the end id only. Null ids come first. Rows that share an id are ordered by a hash of the
    text, then the text, and stay rows of their own. Texts of any length are encoded whole, in slices between white space.
    An empty table writes no file and gives no rows. Other columns are not read.
    """
    path = shared_path(docs.sparkSession, "sst")
    vocabulary = tokenizer or default_tokenizer()
    manifest = write_shards(docs, path, lambda: _encoder(vocabulary), end, shards)
    return read_shards(manifest, path)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker process, with its memory of pieces."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
