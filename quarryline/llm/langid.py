"""Language identification of mixtures.

Each language has a model of hashed letter n-grams (1 to 4, word ends included); 0.5 is added to each count. A document is a
mixture: expectation-maximisation over its words estimates the proportion of each language from the words' n-gram
likelihoods. The set of languages grows from the likeliest one in the order of the full mixture's proportions, as long
as the likelihood gained exceeds the penalty: PENALTY times half the logarithm of the number of words for each further
language. EM takes STEPS steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, small_batches

#: Expected documents of each language that are learned from, drawn by a hash of the id.
MAX_PER_LANGUAGE = 3000
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
STEPS = 8
PENALTY = 2.0
CACHE = 800_000

_WORD = regex.compile(r"\p{L}+")
_ASCII = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)) + bytes(range(128, 256))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    return _WORD.findall(text.lower())


def grams(words: list[str], orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the buckets of all n-grams of the words (each with a mark at both ends), word by word; where each
    word's begin; and the numbers of the words, as words too short have none."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters from here to the word's end
    for n in orders:
        if n > len(codes):
            break
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        have = np.flatnonzero(size >= n)
        starts = np.r_[0, np.cumsum(size[have] - n + 1)[:-1]]
        yield (h[left[: len(h)] >= n] % np.uint64(BUCKETS)).astype(np.int64), starts, have


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # buckets x languages

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language: the sum over its n-grams, over the number of orders."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for bucket, starts, have in grams(words):
            out[have] += np.add.reduceat(self.log_p[bucket], starts, axis=0)
        return out / len(ORDERS)


def train(docs: DataFrame, bound: int = MAX_PER_LANGUAGE) -> Model:
    """From text and non-null lang of rows whose crc32 of the id mod 4 is not 2, in expectation at most bound a language.

    n-grams are counted on the executors; the driver gets BUCKETS counts for each language.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where((id_crc32() % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not have:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    limit = F.create_map(*[x for k, n in have.items() for x in (F.lit(k), F.lit(int(min(1.0, bound / n) * (1 << 30))))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30))
    sample = rows.where(draw < limit[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for a in range(0, len(texts), 100):
                    if words := [w for t in texts[a : a + 100] for w in words_of(t)]:
                        counts[lang] += np.bincount(np.concatenate([g for g, _, _ in grams(words)]), minlength=BUCKETS)
        for lang, c in counts.items():
            yield pd.DataFrame({"lang": lang, "bucket": np.flatnonzero(c), "n": c[c > 0]})

    sums = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(have)
    table = np.zeros((len(langs), BUCKETS))
    at = {k: i for i, k in enumerate(langs)}
    table[sums["lang"].map(at).to_numpy(int), sums["bucket"].to_numpy(int)] = sums["n"].to_numpy(float)
    table += 0.5
    return Model(langs, np.ascontiguousarray(np.log(table / table.sum(axis=1, keepdims=True)).T, np.float32))


def _em(p: np.ndarray, n: np.ndarray, sizes: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages x documents) after some steps and, by document, the log-likelihood beside the scale of p.

    p: languages x words, document by document; n: how often the word occurs; sizes: words of each document.
    """
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    total = np.add.reduceat(n, starts)
    for step in range(steps + 1):
        r = p * np.repeat(pi, sizes, axis=1)
        mix = np.maximum(r.sum(axis=0), np.float32(1e-30))
        if step < steps:
            r *= n / mix
            pi = np.add.reduceat(r, starts, axis=1) / total
    return pi, np.add.reduceat(n * np.log(mix), starts)


def mixtures(log_p: np.ndarray, n: np.ndarray, sizes: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Proportions (documents x languages) of the selected sets.

    log_p: log-likelihood of each word in each language (words x languages), document by document; n: how often the
    document has the word; sizes: the number of words of each document, at least 1.
    """
    docs, langs = len(sizes), log_p.shape[1]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    n = n.astype(np.float32)
    scaled = np.ascontiguousarray((log_p - log_p.max(axis=1, keepdims=True)).T, np.float32)
    p = np.exp(scaled)
    alone = np.add.reduceat((scaled * n).astype(np.float64), starts, axis=1).T
    full = _em(p, n, sizes, np.full((langs, docs), 1 / langs, np.float32), steps)[0].T
    words = np.add.reduceat(n, starts)
    first = alone.argmax(axis=1)
    best = np.zeros((docs, langs))
    best[np.arange(docs), first] = 1
    value = alone.max(axis=1)
    order = np.argsort(-full, axis=1, kind="stable")
    # A second language whose share isn't a word's worth cannot pay for itself.
    active = np.flatnonzero(-np.sort(-full, axis=1)[:, 1] * words >= 1) if langs > 1 else np.zeros(0, int)
    for k in range(2, langs + 1):
        if not len(active):
            break
        rows = np.repeat(np.isin(np.arange(docs), active), sizes)
        pick = np.zeros((len(active), langs), bool)
        np.put_along_axis(pick, order[active, :k], True, axis=1)
        start = np.where(pick, np.maximum(full[active], 1e-3), 0).astype(np.float32)
        start /= start.sum(axis=1, keepdims=True)
        pi, got = _em(np.ascontiguousarray(p[:, rows]), n[rows], sizes[active], np.ascontiguousarray(start.T), steps)
        got = got - penalty * (k - 1) * 0.5 * np.log(words[active] + 1)
        better = got > value[active]
        best[active[better]] = pi.T[better]
        value[active[better]] = got[better]
        active = active[better]
    return best


#: What a worker remembers of the words it has met: by model, their numbers and likelihoods.
_KNOWN: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}


def _known(model: Model, mark: str, words: set[str]) -> tuple[dict[str, int], np.ndarray]:
    if mark not in _KNOWN or len(_KNOWN[mark][0]) > CACHE:
        _KNOWN.clear()
        _KNOWN[mark] = {}, [np.zeros((0, len(model.langs)), np.float32)]
    known, parts = _KNOWN[mark]
    new = [w for w in words if w not in known]
    for a in range(0, len(new), 50_000):
        part = new[a : a + 50_000]
        parts.append(model.words(part))
        known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
    if len(parts) > 1:
        parts[:] = [np.concatenate(parts)]
    return known, parts[0]


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep of docs, and lang_pred, score, proportions (map of the selected languages).

    lang_pred has the largest proportion, which is the score; 'und' with score 0 and no proportions where the text is
    null or has no letter, or where nothing was learned.
    """
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    schema = src.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.create_map(F.lit(""), F.lit(0.0)).alias("proportions")).schema
    shared, mark = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            pred, score, props = ["und"] * b.num_rows, np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            found = [words_of(t.as_py()) for t in b.column(b.num_columns - 1)] if own.langs else []
            have = [i for i, ws in enumerate(found) if ws]
            if have:
                known, table = _known(own, mark, set().union(*found))
                ids, counts = [], []
                for i in have:
                    u, c = np.unique(np.fromiter(map(known.__getitem__, found[i]), np.int32, len(found[i])), return_counts=True)
                    ids.append(u)
                    counts.append(c)
                pi = mixtures(table[np.concatenate(ids)], np.concatenate(counts), np.fromiter(map(len, ids), np.int64))
                for j, i in enumerate(have):
                    k = int(pi[j].argmax())
                    pred[i], score[i] = own.langs[k], min(1.0, float(pi[j, k]))
                    props[i] = [(own.langs[x], float(pi[j, x])) for x in np.flatnonzero(pi[j] > 1e-6)]
            cols = [pa.array(pred, pa.string()), pa.array(score), pa.array(props, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*keep, "lang_pred", "score", "proportions"])

    return src.mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learned as in :func:`train`; only the text enters a prediction. Null ids count as the empty id. Repeated rows are
    rows of their own; an empty table gives no rows; columns other than doc_id, text and lang are not read.
    """
    out = identify(docs, train(docs), ["doc_id"])
    return out.select("doc_id", (id_crc32() % 4 == 2).alias("held_out"), "lang_pred", "score")
