"""Packing documents into sequences of fixed length along a space-filling curve.

A document's tokens are hashed to a vector of BUCKETS entries (1 + log of the count, with a sign), which a fixed Gaussian
matrix projects to DIMENSIONS coordinates. Each coordinate becomes a whole number of BITS bits, and the cell's place on
the Hilbert curve through all cells is the document's key. Documents are range-sorted by key, so that neighbours in a
sequence are alike, and laid end to end; every LENGTH tokens a sequence ends, and the document under the cut goes on in
the next one. The last, shorter stretch is cut into powers of two, so no sequence has padding.

Only (row, key, number of tokens) is sorted. From it each document gets the number of tokens before it on the curve, and
with that number its pieces are known without its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .encoder import Encoder
from .sstable import _encoder, default_tokenizer

LENGTH = 2048
END = 1
BUCKETS, DIMENSIONS, BITS = 1024, 4, 15
SEED = 11


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (a column a dimension, whole numbers of ``bits`` bits).

    From the highest bit down, each level's orthant is read, and the coordinates below it are flipped (in the first
    dimension) or exchanged with the first, so that the curve inside the orthant joins those of its neighbours.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for j in range(dims):
            on = (x[:, j] >> level & 1).astype(bool)
            swap = np.where(on, 0, (x[:, 0] ^ x[:, j]) & below)
            x[:, 0] ^= np.where(on, below, swap)
            if j:
                x[:, j] ^= swap
    for j in range(1, dims):  # Gray decoding across the dimensions
        x[:, j] ^= x[:, j - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for j in range(dims):
            key = key << 1 | (x[:, j] >> level & 1)
    return key


_GAUSSIAN = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))


def coordinates(ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Projected vectors of n documents; ids are their tokens and owner the document of each."""
    pair, count = np.unique(owner.astype(np.int64) << 32 | ids.astype(np.int64), return_counts=True)
    own, token = pair >> 32, (pair & 0xFFFFFFFF).astype(np.uint64)
    mixed = (token + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS
    weight = 1 + np.log(count)
    signed = np.where(mixed >> np.uint64(63), -weight, weight)
    out = np.stack([np.bincount(own, signed * _GAUSSIAN[bucket, j], n) for j in range(DIMENSIONS)], axis=1)
    return out / np.sqrt(np.maximum(np.bincount(own, weight * weight, n), 1e-300))[:, None]


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document's tokens; one without tokens lies at the middle of the space."""
    size = [len(x) for x in ids]
    z = coordinates(np.concatenate(ids) if ids else np.empty(0, np.int64), np.repeat(np.arange(len(ids)), size), len(ids))
    z[np.array(size, np.int64) == 0] = 0
    share = 1 / (1 + np.exp(-1.702 * z))  # close to the normal distribution's: coordinates fill the cells evenly
    return hilbert_key(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encoded(docs: DataFrame, encoder: Callable[[], Encoder], end: int = END) -> DataFrame:
    """Written: rid (a number for the row), doc_id, key, n_tokens and ids (little-endian, encoder().width bytes each), with
    the end id last. The key is that of the ids before it."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        last = np.array([end], coder.dtype).tobytes()
        for b in batches:
            if b.num_rows:
                data = coder.encode(b.column(1).to_pylist())
                key = curve_keys([np.frombuffer(x, coder.dtype) for x in data])
                size = pa.array([len(x) // coder.width + 1 for x in data], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key), size, pa.array([x + last for x in data], pa.binary())], names=["doc_id", "key", "n_tokens", "ids"])

    done = rows.mapInArrow(run, f"doc_id {kind}, key long, n_tokens long, ids binary")
    return written(done.withColumn("rid", F.monotonically_increasing_id()), "packing-ids")


def along_curve(rows: DataFrame) -> DataFrame:
    """(rid, before): the tokens of all rows before this one on the curve. Rows with one key are in the order of rid, and
    may lie in many partitions."""
    ordered = rows.select("rid", "key", "n_tokens").repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "rid")
    ordered = written(ordered.withColumn("part", F.spark_partition_id()), "curve-order")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    within = Window.partitionBy("part").orderBy("key", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(F.broadcast(parts.select("part", "first")), "part").select("rid", (F.col("first") + F.col("inside")).alias("before"))


def cuts(before: int, n: int, total: int, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(start, size, sequence, offset) of the pieces of a document of n tokens that has ``before`` tokens before it.

    Behind the last full sequence, the rest of the ``total`` tokens is cut by the binary digits of their number.
    """
    out = []
    full = total // length
    at, stop = before, before + n
    first, size, seq = at // length * length, length, at // length
    if at >= full * length:
        first, size, seq = full * length, 0, full - 1
    while at < stop:
        while first + size <= at:  # the next sequence
            first, seq = first + size, seq + 1
            size = length if seq < full else 1 << ((total - first).bit_length() - 1)
        take = min(stop, first + size) - at
        out.append((at - before, take, seq, at - first))
        at += take
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids are the piece's tokens as little-endian unsigned 32-bit numbers. A null or empty text has the end id only. Null and
    repeated ids stay documents of their own; equal rows follow one another. Texts of any length are encoded whole and cut
    into as many pieces as they need. An empty table gives no rows. Other columns are not read.
    """
    vocabulary = tokenizer or default_tokenizer()
    rows = encoded(docs, lambda: _encoder(vocabulary), end)
    width = _width(vocabulary)
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    small_batches(docs.sparkSession, 500)
    ready = rows.join(along_curve(rows), "rid").select("doc_id", "before", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, rest, data = [], [], []
            for k, (before, value) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                ids = np.frombuffer(value.as_buffer(), f"<u{width}").astype("<u4")
                for start, n, seq, offset in cuts(before, len(ids), total, length):
                    own.append(k)
                    rest.append((start, n, len(ids), seq, offset))
                    data.append(ids[start : start + n].tobytes())
            if own:
                start, n, whole, seq, offset = (pa.array(c, pa.int64()) for c in zip(*rest, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), start, n, pa.array(data, pa.binary()), whole, seq, offset], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return ready.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _width(path: str) -> int:
    return Encoder(path).width


def sequences(pieces: DataFrame) -> DataFrame:
    """A row for each sequence: sequence_id, n_tokens, ids (all its tokens) and pieces (doc_id, start, length, offset in
    order). A sequence has a bounded number of tokens, so a group is small."""
    one = F.struct("offset", "doc_id", "start", "length", "ids")
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(one)).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), joined.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("pieces"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """pack() with the crc32 of each piece's ids in their place."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

