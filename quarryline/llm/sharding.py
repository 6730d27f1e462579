"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has RING_CELLS cells. Each shard owns ``vnodes`` of them; a cell belongs to the first virtual node at or
after it, clockwise. Only row counts of cells reach the driver (at most RING_CELLS numbers, whatever the input).
From them it decides which ranks of which cell stay with the owner and which overflow to the next shard with room;
rows then find their shard and slot from their rank within the cell.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A power of two; fixes the size of what the driver gathers and broadcasts.
RING_CELLS = 1 << 16
VNODES = 64


def ring(shards: int, vnodes: int = VNODES, cells: int = RING_CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in clockwise order. A node whose cell is taken goes to the next free one."""
    if shards * vnodes > cells:
        raise ValueError("more virtual nodes than cells")
    owner: dict[int, int] = {}
    for v in range(vnodes):
        for s in range(shards):
            at = int.from_bytes(hashlib.md5(f"{s}:{v}".encode()).digest()[:8], "big") % cells
            while at in owner:
                at = (at + 1) % cells
            owner[at] = s
    return sorted(owner.items())


def place(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = RING_CELLS) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, from rank, to rank, shard, slot of the first) that cover each cell's ranks once.

    Loads are bounded by capacities that add up to the number of rows: they differ by one at most, and every shard
    ends full. A shard first takes the rows of its own arcs in ring order; what it can't hold is carried clockwise.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot = [0] * shards
    nodes = ring(shards, vnodes, cells)
    arcs: list[list[int]] = [[] for _ in nodes]
    j = 0
    for c in sorted(counts):
        while j < len(nodes) and nodes[j][0] < c:
            j += 1
        arcs[j % len(nodes)].append(c)  # beyond the last node: the first, clockwise
    out: list[tuple[int, int, int, int, int]] = []

    def take(s: int, cell: int, lo: int, hi: int) -> int:
        n = min(hi - lo, room[s])
        if n:
            out.append((cell, lo, lo + n, s, slot[s]))
            room[s] -= n
            slot[s] += n
        return lo + n

    spilled: list[list[tuple[int, int, int]]] = []
    for (_, s), own in zip(nodes, arcs, strict=True):
        left = [(c, take(s, c, 0, counts[c]), counts[c]) for c in own]
        spilled.append([x for x in left if x[1] < x[2]])
    carried: deque[tuple[int, int, int]] = deque()
    for lap in range(2):
        for (_, s), left in zip(nodes, spilled, strict=True):
            while carried and room[s]:
                c, lo, hi = carried.popleft()
                if (lo := take(s, c, lo, hi)) < hi:
                    carried.appendleft((c, lo, hi))
            if lap == 0:
                carried.extend(left)
    assert not carried and not any(room)
    return out


def shard_rows(docs: DataFrame, shards: int = 16, vnodes: int = VNODES, cells: int = RING_CELLS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shards differ by one row at most. size is the UTF-8 bytes of the text (null: none) plus 1.
    slot counts each shard's rows from 0 without gaps. grown_shard is null: it belongs to another law.

    The position on the ring comes from doc_id and the text's checksum and size, so rows that share an id still
    spread; a null id is a value like any other. Equal rows are told apart by their place in a written table, which
    never changes. Rows fewer than shards leave shards empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 64 - (cells.bit_length() - 1)).cast("int"))
    rows = written(rows, "ring-rows")
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most `cells` rows
    segments = spark.createDataFrame(place(counts, shards, vnodes, cells) if counts else [], "cell int, lo long, hi long, shard int, first long")
    ranked = rows.withColumn("rank", (F.row_number().over(Window.partitionBy("cell").orderBy("h", "doc_id", "rid")) - 1).cast("long"))
    # At most cells + 2 * shards * vnodes segments: a fixed bound on what is broadcast.
    out = ranked.join(F.broadcast(segments), "cell").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
