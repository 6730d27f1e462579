"""Benchmark decontamination with suffix arrays over shards of training text.

A shard is an Arrow batch of documents. Its words become numbers of the benchmark's vocabulary (0: not in it); the
suffix array holds the positions at which a run of vocabulary words is long enough for the shortest test window, since
no other suffix can match one. Suffixes are sorted by prefix doubling to the depth of the longest test item. Each test
suffix is binary-searched in it: the neighbours of its place share the longest verbatim match, and the interval of
suffixes that share the first ten words gives the locations of its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeping, small_batches

WINDOW = 10
#: Bytes of benchmark text that are matched in one pass; more items take more passes.
BLOCK_BYTES = 16 << 20

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_KEEP).split()


class TestSet:
    """The windows of a set of items over their own vocabulary."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.window = window
        texts: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text))
            if ids:
                texts.setdefault(ids, []).append("" if item is None else str(item))
        self.texts = [np.array(t, np.int32) for t in texts]
        self.items = list(texts.values())
        self.least = min([window, *map(len, self.texts)])
        self.depth = max([window, *map(len, self.texts)])
        #: Distinct suffixes that start a window: (text, start, words of the window).
        self.starts = [(k, s, min(window, len(t))) for k, t in enumerate(self.texts) for s in range(max(1, len(t) - window + 1))]


def suffix_array(tokens: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` in the order of their suffixes, compared over ``depth`` tokens at most; ties by position.

    Prefix doubling over the candidate positions: a suffix's rank at width 2w is the pair of ranks at width w of
    itself and of the one w further on. Positions that are no candidates stand for their first token only, which
    keeps the order right: a candidate's run goes on through them token by token.
    """
    if not len(at):
        return at
    n = len(tokens)
    padded = np.concatenate([tokens, np.zeros(1, tokens.dtype)]).astype(np.int64)
    rank = padded.copy()
    width = 1
    mark = np.zeros(n + depth + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + depth, -1)
    need = np.flatnonzero(np.cumsum(mark)[: n + 1])
    while width < depth:
        ahead = rank[np.minimum(need + width, n)]
        ahead = np.where(need + width > n, 0, ahead)
        pair = rank[need] * (int(rank.max()) + 1) + ahead
        new = np.zeros(n + 1, np.int64)
        new[need] = np.unique(pair, return_inverse=True)[1] + 1
        new[n] = 0
        rank = new
        width *= 2
    return at[np.lexsort((at, rank[at]))]


def _lower_bound(tokens: np.ndarray, order: np.ndarray, query: list[int], above: bool) -> int:
    """First place in order whose suffix is not less than query (above: is greater than all that start with it)."""
    lo, hi, m = 0, len(order), len(query)
    while lo < hi:
        mid = (lo + hi) // 2
        own = tokens[order[mid] : order[mid] + m].tolist()
        if own < query or above and own == query:
            lo = mid + 1
        else:
            hi = mid
    return lo


def find(tests: TestSet, tokens: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Matches (text, start in it, position in tokens, words that match from there on) for each occurrence of a window.

    tokens: vocabulary numbers, 0 where nothing may match (other words, ends of documents).
    """
    if not tests.starts or not len(tokens):
        return []
    dead = np.flatnonzero(np.r_[tokens, [0]] == 0)
    run = dead[np.searchsorted(dead, np.arange(len(tokens)))] - np.arange(len(tokens))
    firsts = np.zeros(len(tests.vocab) + 1, bool)
    firsts[[int(tests.texts[k][s]) for k, s, _ in tests.starts]] = True
    at = np.flatnonzero((run >= tests.least) & firsts[tokens])
    order = suffix_array(tokens, at, tests.depth)
    out = []
    for k, s, m in tests.starts:
        query = tests.texts[k][s:].tolist()
        head = query[:m]
        lo = _lower_bound(tokens, order, head, False)
        if lo == len(order) or tokens[order[lo] : order[lo] + m].tolist() != head:
            continue
        hi = _lower_bound(tokens, order, head, True)
        for p in order[lo:hi].tolist():
            n = m
            while n < len(query) and p + n < len(tokens) and tokens[p + n] == query[n]:
                n += 1
            out.append((k, s, p, n))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of bounded size; only one block is on the driver at a time."""
    rows = benchmark.select("item_id", "text").where("item_id is not null or text is not null")
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("b")).first()["b"] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows
        yield [(r["item_id"], r["text"]) for r in part.collect()]


SPANS = "array<struct<item_id:string,item_start:int,word:int,n_words:int>>"


def with_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns keep of docs, and
    n_words; hits: (word, n_words) of the merged spans of document words inside occurrences; matches: by item, the place
    of each occurrence of one of its windows and how many words match verbatim from there on; item_ids: sorted as strings.

    The documents pass once for each block of items; spans are merged from block to block, and texts aren't shuffled.
    """
    small_batches(docs.sparkSession, 2000)
    cols = [F.col(f"`{c}`") for c in keep]
    df = docs.select(*cols, F.col("text").alias("__text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<word:int,n_words:int>>").alias("hits"), F.array().cast(SPANS).alias("matches"))
    for items in _blocks(benchmark, block_bytes):
        df = df.mapInArrow(_matcher(TestSet(items, window)), df.schema)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return df.select(*cols, "n_words", "hits", "matches", ids.alias("item_ids"))


def _matcher(tests: TestSet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = tests.vocab.get
        for b in batches:
            text, old_hits, old_matches = b.column("__text"), b.column("hits").to_pylist(), b.column("matches").to_pylist()
            counts, parts = [], []
            for t in text:
                words = words_of(t.as_py())
                counts.append(len(words))
                parts.append(np.array([*map(get, words, [0] * len(words)), 0], np.int32))
            start = np.cumsum([0, *map(len, parts)])
            found = find(tests, np.concatenate(parts) if parts else np.zeros(0, np.int32))
            by: dict[int, list[tuple[int, int, int, int]]] = {}
            for k, s, p, n in found:
                d = int(np.searchsorted(start, p, "right")) - 1
                by.setdefault(d, []).append((k, s, p - int(start[d]), n))
            for d, own in by.items():
                old_matches[d] = old_matches[d] + [{"item_id": i, "item_start": s, "word": p, "n_words": n} for k, s, p, n in own for i in tests.items[k]]
                spans = sorted([(h["word"], h["word"] + h["n_words"]) for h in old_hits[d]] + [(p, p + n) for _, _, p, n in own])
                merged: list[list[int]] = []
                for a, z in spans:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                old_hits[d] = [{"word": a, "n_words": z - a} for a, z in merged]
            names = b.schema.names
            new = {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(old_hits, b.schema.field("hits").type), "matches": pa.array(old_matches, b.schema.field("matches").type)}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], schema=b.schema)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ten consecutive words of an item, or all words of a shorter item; a document word is hit if it is
    inside an occurrence of a window. Null texts have no words and no windows. Items with equal texts all count;
    repeated item ids count once. Empty tables: no rows, or no hits. Repeated documents are rows of their own.
    """
    out = with_matches(docs, benchmark, ["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["n_words"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window occurs, with all their columns."""
    return keeping(docs, ("doc_id", "text"), lambda d, own: with_matches(d, benchmark, own).where(F.size("hits") == 0).select(*own))
