"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are split into BLOCKS blocks. Two that differ in at most MAX_DISTANCE bits agree in at least
BLOCKS - MAX_DISTANCE whole blocks, so they meet under one of the C(6, 3) = 20 keys made of three blocks (32 bits of
key: chance meetings stay rare at billions of fingerprints). Rows that meet are verified by Hamming distance.

Equal fingerprints are merged first. A key's members are dealt to chunks of CHUNK rows, and each pair of chunks is a
unit of work; so a very large bucket is compared in full, by many tasks, none of which holds more than two chunks.
A unit reports a spanning forest of its links (a row at most per member), never all pairs. Links are closed to
components by alternating large-star and small-star steps over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeping, small_batches, written

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 3
#: Widths of the blocks, from the lowest bit.
BLOCKS = (11, 11, 11, 11, 10, 10)
CHUNK = 2048


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if it has fewer words; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z, splits at space and \x09-\x0d
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of docs and fp (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    schema = src.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return src.mapInArrow(run, schema)


def block_masks(blocks: tuple[int, ...] = BLOCKS, distance: int = MAX_DISTANCE) -> list[int]:
    """A mask for each choice of blocks that close fingerprints must share."""
    at = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    one = [((1 << w) - 1) << a for w, a in zip(blocks, at, strict=False)]
    return [sum(c) for c in combinations(one, len(blocks) - distance)]


def unit_roots(fps: np.ndarray, distance: int = MAX_DISTANCE) -> np.ndarray:
    """For distinct fingerprints of one unit: the index of the smallest member that each is linked to, directly or not."""
    n = len(fps)
    label = np.arange(n)
    close = np.empty((n, n), bool)
    for a in range(0, n, 256):
        close[a : a + 256] = np.bitwise_count(fps[a : a + 256, None] ^ fps[None, :]) <= distance
    while True:
        new = np.empty_like(label)
        for a in range(0, n, 256):
            new[a : a + 256] = np.where(close[a : a + 256], label[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def sorted_roots(group: np.ndarray, fps: np.ndarray, distance: int = MAX_DISTANCE) -> np.ndarray:
    """As unit_roots for many units at once, given row by row as numbers that ascend."""
    n = len(group)
    label = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    big = sizes > 32
    for a, m in zip(starts[big].tolist(), sizes[big].tolist(), strict=True):
        label[a : a + m] = a + unit_roots(fps[a : a + m], distance)
    size = np.repeat(np.where(big, 0, sizes), sizes)
    edges = []
    for lag in range(1, int(size.max(initial=1))):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & (size[lag:] > 0))
        i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= distance]
        edges.append((i, i + lag))
    if edges:
        a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
    return label


def links(fps: DataFrame, blocks: tuple[int, ...] = BLOCKS, distance: int = MAX_DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """(u, v), u > v as written: links between the distinct fingerprints in fps (column fp) that span all components."""
    small_batches(fps.sparkSession, 20000)
    masks = block_masks(blocks, distance)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(np.uint64(m).astype(np.int64).item())).alias("k")) for i, m in enumerate(masks)])).alias("b"))
    keyed = keyed.select("fp", "b.t", "b.k")
    shared = written(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "block-counts")
    met = keyed.join(shared, ["t", "k"]).withColumn("c", F.ceil(F.col("n") / chunk).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    units = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    units = units.select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = units.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None

        def done(rows: np.ndarray) -> pa.RecordBatch:
            new = np.r_[False, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]
            root = sorted_roots(np.cumsum(new), rows[:, 4].view(np.uint64), distance)
            moved = root != np.arange(len(rows))
            a, b = rows[moved, 4], rows[root[moved], 4]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            rows = rows if rest is None else np.concatenate([rest, rows])
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last unit may go on in the next batch
            rest = np.ascontiguousarray(rows[cut:])
            if cut:
                yield done(np.ascontiguousarray(rows[:cut]))
        if rest is not None and len(rest):
            yield done(rest)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour. Grouped under another key than it is joined by, so that the join has exchanges
    of its own, whose large partitions Spark can split."""
    return edges.groupBy(F.bitwise_not("u").alias("w")).agg(F.min("v").alias("m")).select(F.bitwise_not("w").alias("u"), "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (u, v), u > v: root is the smallest node that it reaches; roots too."""
    edges = written(edges, "links")
    state = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large, "large-star")
        low = _least(large)
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of prints (doc_id, fp): the smallest id that each reaches.

    Equal fingerprints are at distance 0, hence linked. Null ids count only where a component has no other.
    """
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    roots = written(components(links(fps.select("fp"))), "roots")
    member = written(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "members")
    least = written(member.groupBy("root").agg(F.min("least_id").alias("component_id")), "component-ids")
    return written(member.join(least, "root").select("fp", "component_id"), "component-of")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    A null or empty text has fingerprint 0 and is linked like any other. Repeated rows and ids stay rows of their own.
    A component of null ids has a null id. An empty table gives no rows. Other columns are not read.
    """
    prints = written(with_fingerprint(docs, ["doc_id"]), "prints")
    return prints.join(fingerprint_components(prints), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
