"""Alignment of two tokenizers' tokens over the same bytes.

Both cover a text's bytes, so each is a list of ends. The union of the two lists cuts the bytes into elementary intervals;
in each lies a part of one token of A and one of B, found by binary search, and each interval is one overlapping pair, a
link. Ends that both have close a group: its A tokens stand for its B tokens.

A text is cut before blanks and line feeds that follow other than white space. Neither tokenizer has a token across such a
place (vocabularies are held against that rule; others' texts are aligned whole), so both end there and a piece's groups
and links are the same wherever it stands. A task aligns each distinct piece once, many at a time, and a document is the
row of its pieces.

How often an id pair is linked is counted over the corpus. A task emits its documents in blocks, as counts of the
block's pieces, and each block's pairs once. Pairs are summed, their totals go back to the blocks that hold them, and a
document's figures follow from its block: no task needs the table of all pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .encoder import byte_characters

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: What is remembered is dropped beyond so many pieces (about 300 bytes each).
ENTRIES = 400_000
#: Longer pieces are aligned anew each time.
PIECE = 200
#: A block of documents holds about so many characters of text.
BLOCK = 1 << 23
_META = "▁"


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two ascending lists of ends with one last: for each elementary interval the number of its A token and of its B
    token, and for each group the number of its last A token and of its last B token."""
    ends = np.union1d(a_ends, b_ends)
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), np.searchsorted(a_ends, shared), np.searchsorted(b_ends, shared)


def groups_text(a_ids: list[int], b_ids: list[int], a_last: list[int], b_last: list[int]) -> str:
    """``a1,a2|b1;a3|b2,b3``: ids of the groups that end at these tokens."""
    out, i, j = [], 0, 0
    for x, y in zip(a_last, b_last, strict=True):
        out.append(f"{','.join(map(str, a_ids[i : x + 1]))}|{','.join(map(str, b_ids[j : y + 1]))}")
        i, j = x + 1, y + 1
    return ";".join(out)


class Pair:
    """The two tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        of = {c: i for i, c in enumerate(byte_characters())}
        self.a_bytes: dict[int, bytes] = {}
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_META, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_sizes = np.array(list(map(len, self.b_bytes)))
        self.blank = self.b.piece_to_id(_META)
        #: No B token goes on into a blank or holds a line feed; of A that follows from its splitting.
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = not any(re.search(f"[^{_META}]{_META}|\n", p) for p in plain) and pieces[self.blank] == _META and _splits_at_blanks(a_path)

    def tokens(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """A's ids of space + text and B's of text, for each text."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for x, y in zip(a, self.b.encode(texts, num_threads=1), strict=True):
            yield x.ids, y

    def piece_tokens(self, pieces: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of pieces of a text, which begin with a blank or a line feed."""
        a = self.a.encode_batch_fast(pieces, add_special_tokens=False)
        # B puts a blank before what it is given: here the piece's own, or one too many before a line feed
        b = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        for p, x, y in zip(pieces, a, b, strict=True):
            yield x.ids, [self.blank] if p == " " else y[1:] if p[0] == "\n" else y

    def joined(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        return b"".join([self.a_bytes[i] for i in a]), b"".join([self.b_bytes[i] for i in b])

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])


def _splits_at_blanks(path: str) -> bool:
    """Whether the file splits as byte-level vocabularies do: before each run of white space, of which a last blank may
    belong to the word behind it."""
    import json

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre = d.get("pre_tokenizer") or {}
    return d.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not (d.get("model") or {}).get("dropout")


_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_ODD_SPACE = re.compile(r"[^\S \n]")


def pieces_of(text: str) -> list[str]:
    """Keys of the pieces of space + text: a word for the blank and the word, a line feed and what follows for itself, any
    other piece behind one more blank."""
    body = text.replace("\n", " \n")
    if "  " not in body and "\n " not in body and body[0] not in " \n" and not _ODD_SPACE.search(body):
        return body.split(" ")
    return [p[1:] if p[0] == " " and p[1:2] not in (" ", "\n") else p if p[0] == "\n" else " " + p for p in _CUT.split(" " + text)]


def piece_of(key: str) -> str:
    return key[1:] if key[:1] == " " else key if key[:1] == "\n" else " " + key


class Memory:
    """What is known of pieces, by number: counts, the groups as text, and the linked id pairs (A's in the high half)."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.figures = np.zeros((1024, 4), np.int32)  # A tokens, B tokens, groups, links; all -1: the bytes differ
        self.ends = np.zeros(1024, np.int64)
        self.links = np.zeros(1 << 14, np.int64)
        self.used = 0

    def learn(self, keys: list[str]) -> None:
        """Aligns new pieces together: their tokens in a row are one long text."""
        pieces = list(map(piece_of, keys))
        own = list(self.pair.piece_tokens(pieces))
        a_all, b_all = [i for x, _ in own for i in x], [i for _, y in own for i in y]
        want = "".join(pieces).encode()
        fine = np.ones(len(keys), bool)
        if self.pair.joined(a_all, b_all) != (want, want) or not self._fit(own, pieces):
            fine = np.array([self.pair.joined(a, b) == ((p := x.encode()), p) for x, (a, b) in zip(pieces, own, strict=True)])
            own = [x for x, s in zip(own, fine.tolist(), strict=True) if s]
            a_all, b_all = [i for x, _ in own for i in x], [i for _, y in own for i in y]
        a_ids, b_ids = np.array(a_all, np.int64), np.array(b_all, np.int64)
        a_at, b_at, a_last, b_last = group_ends(*self.pair.ends(a_ids, b_ids))
        n_a, n_b = (np.cumsum([len(x[k]) for x in own], dtype=np.int64) for k in (0, 1))
        link_ends, group_upto = np.searchsorted(a_at, n_a), np.searchsorted(a_last, n_a)
        codes = a_ids[a_at] << 32 | b_ids[b_at]
        self._reserve(len(keys), len(codes))
        base, n = self.used, len(self.groups)
        rows = np.full((len(keys), 4), -1, np.int32)
        rows[fine] = np.stack([np.diff(x, prepend=0) for x in (n_a, n_b, group_upto, link_ends)], axis=1)
        self.figures[n : n + len(keys)] = rows
        self.links[base : base + len(codes)] = codes
        self.used += len(codes)
        self.ends[n : n + len(keys)] = base + np.cumsum(np.maximum(rows[:, 3], 0))
        texts = self._texts(a_all, b_all, a_last, b_last, group_upto)
        if not fine.all():
            known = iter(texts)
            texts = [next(known) if s else b"" for s in fine.tolist()]
        self.groups += texts
        self.number.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _fit(self, own: list[tuple[list[int], list[int]]], pieces: list[str]) -> bool:
        """Whether the tokens of each piece have as many bytes as it."""
        a, b = self.pair.ends(*(np.array([i for x in own for i in x[k]], np.int64) for k in (0, 1)))
        size = np.cumsum([len(p.encode()) for p in pieces])
        places = [np.cumsum([len(x[k]) for x in own]) - 1 for k in (0, 1)]
        return all(min(map(len, (x[k] for x in own))) > 0 for k in (0, 1)) and (a[places[0]] == size).all() and (b[places[1]] == size).all()

    @staticmethod
    def _texts(a_ids: list[int], b_ids: list[int], a_last: np.ndarray, b_last: np.ndarray, upto: np.ndarray) -> list[bytes]:
        a, b = list(map(str, a_ids)), list(map(str, b_ids))
        groups, i, j = [], 0, 0
        for x, y in zip(a_last.tolist(), b_last.tolist(), strict=True):
            groups.append(f"{a[i] if x == i else ','.join(a[i : x + 1])}|{b[j] if y == j else ','.join(b[j : y + 1])}")
            i, j = x + 1, y + 1
        stops = upto.tolist()
        return [";".join(groups[x:y]).encode() for x, y in zip([0, *stops], stops, strict=False)]

    def _reserve(self, pieces: int, links: int) -> None:
        while len(self.groups) + pieces > len(self.ends):
            self.ends, self.figures = np.r_[self.ends, np.zeros_like(self.ends)], np.r_[self.figures, np.zeros_like(self.figures)]
        while self.used + links > len(self.links):
            self.links = np.r_[self.links, np.zeros_like(self.links)]

    def links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of pieces in a row, and how many each has."""
        size = np.maximum(self.figures[numbers, 3], 0).astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.links[np.repeat(self.ends[numbers] - ends, size) + np.arange(total)], size


_EMPTY = (0, 0, 0, 0, "")


class Aligner:
    """Documents to figures and pieces, with one memory for a worker process."""

    def __init__(self, a_path: str, b_path: str, entries: int = ENTRIES):
        self.pair, self.entries = Pair(a_path, b_path), entries
        self.memory = Memory(self.pair)

    def whole(self, text: str) -> tuple[tuple[int, int, int, int, str], np.ndarray]:
        """The figures and the links of a text, without cutting it."""
        ((a, b),) = self.pair.tokens([text])
        want = (" " + text).encode()
        if self.pair.joined(a, b) != (want, want):
            return _EMPTY, np.empty(0, np.int64)
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_at, b_at, a_last, b_last = group_ends(*self.pair.ends(a_ids, b_ids))
        digest = hashlib.sha256(groups_text(a, b, a_last.tolist(), b_last.tolist()).encode()).hexdigest()
        return (len(a), len(b), len(a_last), len(a_at), digest), a_ids[a_at] << 32 | b_ids[b_at]

    def documents(self, texts: list[str | None]) -> Iterator[tuple[tuple[int, int, int, int, str], np.ndarray | None, np.ndarray | None]]:
        """For each text (figures, numbers of its pieces, None), or (figures, None, links) of one that is aligned whole."""
        keys = [pieces_of(t) if t and self.pair.cuts else None for t in texts]
        keys = [k if k is not None and max(map(len, k)) <= PIECE else None for k in keys]
        number = self.memory.number
        new = list(dict.fromkeys(x for k in keys if k is not None for x in k if x not in number))
        for i in range(0, len(new), 20_000):
            self.memory.learn(new[i : i + 20_000])
        get, groups = number.__getitem__, self.memory.groups.__getitem__
        for t, k in zip(texts, keys, strict=True):
            if not t:
                yield _EMPTY, None, np.empty(0, np.int64)
                continue
            if k is not None:
                numbers = list(map(get, k))
                at = np.array(numbers, np.int64)
                figures = self.memory.figures[at]
                if (figures[:, 0] >= 0).all():
                    digest = hashlib.sha256(b";".join(map(groups, numbers))).hexdigest()
                    yield (*figures.sum(axis=0, dtype=np.int64).tolist(), digest), at, None
                    continue
            figures, links = self.whole(t)
            yield figures, None, links


class _Block:
    """Documents whose pieces are numbered anew, from 0."""

    def __init__(self, memory: Memory):
        self.memory, self.size = memory, 0
        self.docs: list[tuple] = []
        self.own: list[tuple[np.ndarray | None, np.ndarray | None]] = []

    def add(self, doc_id, figures: tuple, numbers: np.ndarray | None, links: np.ndarray | None, size: int) -> None:
        self.docs.append((doc_id, *figures))
        self.own.append((*np.unique(numbers, return_counts=True), None) if numbers is not None else (None, None, np.unique(links, return_counts=True)))
        self.size += size

    def batches(self, name: int, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        used = [p for p, _, _ in self.own if p is not None]
        numbers = np.unique(np.concatenate(used)) if used else np.empty(0, np.int64)
        times = np.zeros(len(numbers), np.int64)
        for p, c, _ in self.own:
            if p is not None:
                times[np.searchsorted(numbers, p)] += c
        links, size = self.memory.links_of(numbers)
        loose = [x for _, _, x in self.own if x is not None]
        codes = np.concatenate([links, *[x[0] for x in loose]])
        times = np.concatenate([np.repeat(times, size), *[x[1] for x in loose]])
        pairs, at = np.unique(codes, return_inverse=True)
        total = np.bincount(at, times, len(pairs)).astype(np.int64)
        row = {"block": [name], "a": [pairs >> 32], "b": [pairs & 0xFFFFFFFF], "n": [total], "piece_links": [size], "link_pair": [at[: len(links)]]}
        yield _batch(row, 1, doc_type)
        for i in range(0, len(self.docs), 500):
            docs, own = self.docs[i : i + 500], self.own[i : i + 500]
            row = {c: list(v) for c, v in zip(_DOC_NAMES, zip(*docs, strict=True), strict=True)}
            row |= {"block": [name] * len(docs), "whole": [p is None for p, _, _ in own]}  # its pairs stand for pieces of one link
            row["piece"] = [np.searchsorted(numbers, p) if p is not None else np.searchsorted(pairs, x[0]) for p, _, x in own]
            row["times"] = [c if p is not None else x[1] for p, c, x in own]
            yield _batch(row, len(docs), doc_type)


_DOC_NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_TYPES = {"block": pa.int64(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "n": pa.list_(pa.int64()), "piece_links": pa.list_(pa.int32()), "link_pair": pa.list_(pa.int32())}
_TYPES |= {c: pa.int64() for c in _DOC_NAMES[:-1]} | {"groups_sha256": pa.string(), "piece": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "whole": pa.bool_()}


def _batch(columns: dict[str, list], n: int, doc_type: pa.DataType) -> pa.RecordBatch:
    """n rows with these columns, of which lists are arrays, and nulls in the others."""
    out = []
    for name, kind in (_TYPES | {"doc_id": doc_type}).items():
        if name not in columns:
            out.append(pa.nulls(n, kind))
        elif pa.types.is_list(kind):
            ends = np.r_[0, np.cumsum(list(map(len, columns[name])))].astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[name]).astype(kind.value_type.to_pandas_dtype()))))
        else:
            out.append(pa.array(columns[name], kind))
    return pa.RecordBatch.from_arrays(out, names=list(_TYPES))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


_DOC = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_BLOCKS = "block long, a array<int>, b array<int>, n array<long>, piece_links array<int>, link_pair array<int>, " + _DOC + ", piece array<int>, times array<int>, whole boolean"


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """Written: for each block of documents a row with its pairs (a, b, n: how often it links them; piece_links and
    link_pair: the pairs of its pieces), and a row for each of its documents, with the block's pieces it has."""
    small_batches(docs.sparkSession, 500)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, task, made = _aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        held = kind = None
        for b in batches:
            kind = b.schema.field(0).type
            if held is not None and held.size >= block:
                yield from held.batches(task << 32 | made, kind)
                made += 1
                held = None
            if held is None:
                if len(aligner.memory.groups) > aligner.entries:  # between blocks: a block's numbers stay valid
                    aligner.memory.clear()
                held = _Block(aligner.memory)
            texts = b.column(1).to_pylist()
            for doc_id, text, found in zip(b.column(0).to_pylist(), texts, aligner.documents(texts), strict=True):
                held.add(doc_id, *found, len(text or ""))
        if held is not None:
            yield from held.batches(task << 32 | made, kind)

    return written(rows.mapInArrow(run, _BLOCKS.format(kind=kind)), "aligned-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best) of all linked id pairs: how many links hold it, and whether no other A id has more with b."""
    each = blocks.where("a IS NOT NULL").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    total = written(each.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    most = total.groupBy("b").agg(F.max("count").alias("most"))
    return total.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and pair_counts().

    A null or empty text, and one whose tokens do not give back its bytes, has zeros and an empty digest. Null and
    repeated ids stay rows of their own; ties for a B id's highest count are all best. Texts of any length are aligned
    whole. An empty table gives no rows. Other columns are not read.
    """
    import public_tokenizers

    blocks = aligned_blocks(docs, a_path or public_tokenizers.path(TOKENIZER_A), b_path or public_tokenizers.path(TOKENIZER_B))
    counts = written(pair_counts(blocks), "best-pairs")
    return _with_counts(blocks, counts), counts


def _with_counts(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    heads = blocks.where("a IS NOT NULL")
    asked = heads.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p")).select("block", "i", "p.a", "p.b")
    known = asked.join(counts, ["a", "b"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("i", "count", "best"))).alias("t"))  # a block's pairs
    known = known.select("block", F.col("t.count").alias("count"), F.col("t.best").alias("best"))
    kind = blocks.schema["doc_id"].dataType.simpleString()
    doc = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    first = heads.join(known, "block").select("block", F.lit(0).alias("part"), "piece_links", "link_pair", "count", "best", *doc, "piece", "times", "whole")
    none = {"count": "array<long>", "best": "array<boolean>"}
    rest = blocks.where("a IS NULL").select("block", F.lit(1).alias("part"), "piece_links", "link_pair", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], *doc, "piece", "times", "whole")
    dealt = first.unionAll(rest).repartition("block").sortWithinPartitions("block", "part")
    small_batches(blocks.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_pair = by_piece = (np.empty(0), np.empty(0))
        flat = lambda x: np.asarray(x.values.to_numpy(zero_copy_only=False))
        for b in batches:
            keep, best, total = [], [], []
            head = b.column(1).to_pylist()
            for k in range(b.num_rows):
                if head[k] == 0:
                    count, top = flat(b.column(4)[k]), flat(b.column(5)[k])
                    by_pair = top.astype(np.int64), count.astype(np.int64)
                    size, at = flat(b.column(2)[k]), flat(b.column(3)[k])
                    upto = np.r_[0, np.cumsum(size, dtype=np.int64)]
                    by_piece = tuple(np.diff(np.r_[0, np.cumsum(x[at])][upto]) for x in by_pair)
                    continue
                piece, times = flat(b.column(12)[k]), flat(b.column(13)[k]).astype(np.int64)
                table = by_pair if b.column(14)[k].as_py() else by_piece
                keep.append(k)
                best.append(int((table[0][piece] * times).sum()) if len(piece) else 0)
                total.append(int((table[1][piece] * times).sum()) if len(piece) else 0)
            if keep:
                rows = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in range(6, 11)], pa.array(best, pa.int64()), pa.array(total, pa.int64()), rows.column(11)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return dealt.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
