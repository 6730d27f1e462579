"""Token ids of whole texts by the tokenizers library, with a memory of what it gives for a piece of text.

The library splits a text into pretokens before its merges, so the ids of a text are those of its pretokens in a row.
For a file with the normaliser and the pattern named below, pretokens are found with array operations over many texts at
once, looked up in a table by a 128-bit hash, and only new ones go to the library. Any other file's texts go through the
library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np

# The file's normaliser and splitting, for which the rules of Pretokens hold.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The ends of that pattern's first alternatives.
ENDINGS = (("s",), ("t",), ("r", "e"), ("v", "e"), ("m",), ("l", "l"), ("d",))

#: Code points below this may be plain: normalisation leaves each alone and all libraries lower-case it alike.
_TOP = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER, _ODD = range(5)


def _kind(c: int) -> int:
    if c in (9, 10, 13, 32):
        return _SPACE
    if c < 33 or 127 <= c <= 160 or c == 0x130 or c >= _TOP:
        return _ODD
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)


_KINDS = np.array([_kind(c) for c in range(_TOP + 1)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if _kind(c) != _ODD else c for c in range(_TOP + 1)], np.uint32)

#: Code points that are worked on at once; a longer run without white space is worked on whole.
SLICE = 1 << 18
#: What is remembered is dropped beyond so many pretokens (about 50 bytes each).
ENTRIES = 2_000_000
_MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)))
_BASE = tuple(map(np.uint64, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as many as were asked for so far."""

    def __init__(self, base: np.uint64):
        self.bases = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.rows = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def get(self, n: int) -> list[np.ndarray]:
        if len(self.rows[0]) < n:
            for i, b in enumerate(self.bases):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                self.rows[i] = np.multiply.accumulate(steps)
        return [r[:n] for r in self.rows]


_POWERS = tuple(map(_Powers, _BASE))


def pretokens(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of code points that end in a space: where each pretoken begins and ends, whether it is an odd piece, and the code
    points, lower-cased in all but odd pieces. An odd piece is what stands between white space and has a code point that
    is not plain; it stays whole."""
    low = np.minimum(codes, _TOP)
    kind = _KINDS[low]
    low = np.where(codes < _TOP, _LOWER[low], codes)
    space = kind == _SPACE
    before = np.r_[np.uint8(_SPACE), kind[:-1]]
    start = ~space & ((kind != before) | (kind == _NUMBER))
    quotes = np.flatnonzero((low[:-1] == ord("'")) & start[:-1])
    if len(quotes):
        at = [low[np.minimum(quotes + i, len(low) - 1)] for i in (1, 2)]
        for ending in ENDINGS:
            hit = np.logical_and.reduce([at[i] == ord(c) for i, c in enumerate(ending)])
            own = quotes[hit]
            start[own + 1] = False
            after = own + len(ending) + 1
            after = after[after < len(low)]
            start[after] = ~space[after]
    odd_at = np.flatnonzero(kind == _ODD)
    spaces = np.flatnonzero(space)
    inside = np.zeros(len(codes), bool)
    if len(odd_at):
        piece = np.unique(np.searchsorted(spaces, odd_at))  # the space that ends the piece
        whole = np.where(piece > 0, spaces[piece - 1] + 1, 0)
        step = np.zeros(len(codes), np.int8)
        step[whole] = 1
        step[spaces[piece]] = -1
        inside = np.cumsum(step, dtype=np.int8).astype(bool)
        start &= ~inside
        start[whole] = True
        low = np.where(inside, codes, low)
    marks = np.flatnonzero(start | space)
    begins = np.flatnonzero(start[marks])
    starts = marks[begins]
    return starts, marks[begins + 1], inside[starts], low


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each stretch: polynomials of its mixed code points, from sums up to each place."""
    out = []
    for mix, powers in zip(_MIX, _POWERS, strict=True):
        up, down = powers.get(len(low) + 1)
        x = (low.astype(np.uint64) + np.uint64(1)) * mix
        x ^= x >> np.uint64(29)
        x *= mix
        x ^= x >> np.uint64(32)
        x *= up[:-1]
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] + odd.astype(np.uint64) * mix
        out.append(h ^ (h >> np.uint64(31)))
    return out[0], out[1]


class Memory:
    """Ids by hash: an open-addressing table of entries, each a stretch of one growing array of ids."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.n, self.used, self.bits = 1, 0, 12  # entry 0: none
        self.table = np.zeros(1 << self.bits, np.int32)
        self.keys = [np.zeros(1024, np.uint64) for _ in range(2)]
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids = np.zeros(1 << 16, self.dtype)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry of each hash, 0 where there is none."""
        slot, mask = self._slots(a), len(self.table) - 1
        out = self.table[slot]
        todo = np.flatnonzero((out > 0) & ((self.keys[0][out] != a) | (self.keys[1][out] != b)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            e = self.table[slot[todo]]
            out[todo] = e
            todo = todo[(e > 0) & ((self.keys[0][e] != a[todo]) | (self.keys[1][e] != b[todo]))]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New, distinct hashes with their ids."""
        n, m = self.n, self.n + len(a)
        while m > len(self.first):
            self.keys = [np.r_[k, np.zeros_like(k)] for k in self.keys]
            self.first, self.size = np.r_[self.first, np.zeros_like(self.first)], np.r_[self.size, np.zeros_like(self.size)]
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.keys[0][n:m], self.keys[1][n:m], self.size[n:m] = a, b, sizes
        self.first[n:m] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = m, self.used + len(ids)
        if 2 * m > len(self.table):
            self.bits = (2 * m - 1).bit_length() + 1
            self.table = np.zeros(1 << self.bits, np.int32)
            n = 1
        self._place(np.arange(n, m))

    def _place(self, todo: np.ndarray) -> None:
        slot, mask = self._slots(self.keys[0][todo]), len(self.table) - 1
        while len(todo):
            free = np.flatnonzero(self.table[slot] == 0)
            one = free[np.unique(slot[free], return_index=True)[1]]
            self.table[slot[one]] = todo[one]
            left = np.ones(len(todo), bool)
            left[one] = False
            todo, slot = todo[left], (slot[left] + 1) & mask

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries in a row, and where those of each end."""
        size = self.size[entries]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.first[entries] - (ends - size), size) + np.arange(total)], ends


def byte_characters() -> list[str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b if b in plain else next(odd)) for b in range(256)]


def _slices(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in groups of about SLICE characters: their numbers and themselves. A longer text is cut behind white space,
    and each of its parts has its number."""
    own: list[int] = []
    parts: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = len(t)
            if end - at > SLICE:
                cut = max(t.rfind(c, at, at + SLICE) for c in " \n\t\r")
                cut = cut if cut >= 0 else min((x for c in " \n\t\r" if (x := t.find(c, at + SLICE)) >= 0), default=end)
                end = min(end, cut + 1)
            if parts and size + end - at > SLICE:
                yield own, parts
                own, parts, size = [], [], 0
            own.append(i)
            parts.append(t[at:end] if end - at < len(t) else t)
            size += end - at + 1
            at = end
    if parts:
        yield own, parts


class Encoder:
    """The ids of texts as bytes: little-endian integers of ``width`` bytes, two where the vocabulary allows it."""

    def __init__(self, path: str, entries: int = ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _rules_hold(path)
        if self.known:
            self.model, self.characters = self.tokenizer.model, byte_characters()
            self.memory, self.entries = Memory(self.dtype), entries

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.known:
            return self.direct(texts)
        plain = [i for i, t in enumerate(texts) if not any(s in t for s in self.special)]
        out: list[list[bytes]] = [[] for _ in texts]
        for own, parts in _slices([texts[i] for i in plain]):
            for i, data in zip(own, self._together(parts), strict=True):
                out[plain[i]].append(data)
        rest = sorted(set(range(len(texts))).difference(plain))
        for i, data in zip(rest, self.direct([texts[i] for i in rest]) if rest else [], strict=True):
            out[i].append(data)
        return [b"".join(x) for x in out]

    def _together(self, parts: list[str]) -> list[bytes]:
        text = " ".join(parts) + " "
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, ends, odd, low = pretokens(codes)
        a, b = hashes(low, starts, ends, odd)
        if self.memory.n > self.entries:
            self.memory.clear()
        entry = self.memory.find(a, b)
        while len(new := np.flatnonzero(entry == 0)):
            new = new[np.unique(a[new], return_index=True)[1]]
            self._learn(text, starts[new], ends[new], odd[new], a[new], b[new])
            entry = self.memory.find(a, b)
        ids, upto = self.memory.gather(entry)
        places = np.cumsum([len(p) + 1 for p in parts])
        stops = np.r_[0, upto][np.searchsorted(starts, places)].tolist()
        return [ids[x:y].tobytes() for x, y in zip([0, *stops], stops, strict=False)]

    def _learn(self, part: str, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        words = [part[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids: list[list[int]] = [[]] * len(words)
        whole = np.flatnonzero(odd).tolist()
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([words[i] for i in whole], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        shown = self.characters.__getitem__
        for i in np.flatnonzero(~odd).tolist():
            w = words[i].lower()
            ids[i] = [t.id for t in self.model.tokenize(w if w.isascii() else "".join(map(shown, w.encode())))]
        self.memory.add(a, b, np.array([x for r in ids for x in r], self.dtype), np.fromiter(map(len, ids), np.int32, len(ids)))


def _rules_hold(path: str) -> bool:
    """Whether the file's normaliser, splitting and model are those that this module's rules are written for."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    split, shown = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    steps = (d.get("pre_tokenizer") or {}).get("pretokenizers") or []
    steps = [{k: v for k, v in s.items() if k != "trim_offsets"} for s in steps]
    model = d.get("model") or {}
    return (
        d.get("normalizer") == NORMALIZER and steps == [split, shown] and model.get("type") == "BPE" and not model.get("dropout")
        and not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in d.get("added_tokens", []))
    )
