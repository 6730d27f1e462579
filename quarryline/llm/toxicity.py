"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and a plain sample of documents whatever their label (U) train a linear classifier in
numpy. With class prior pi, the risk of calling toxic text clean is estimated on P, and the risk of calling clean text
toxic as that on U less pi times that on P, kept from falling below zero:

    R = pi * E_P[l(+)] + max(0, E_U[l(-)] - pi * E_P[l(-)])

Features are hashed words and word beginnings (4 to 6 letters), each counted by a document's distinct words, in training
as in scoring. Those that documents of P have clearly more or less often than those of U, by a likelihood-ratio test that
also holds for few documents, are kept. Training reads a bounded sample (MAX_POSITIVE, MAX_UNLABELLED rows), whose
features are counted and chosen in tasks: the driver gets the chosen ones only. Scoring reads every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, keeping, small_batches, written

#: Bounds of the training sample, in documents; expected sizes of samples drawn by a hash of id and text.
MAX_POSITIVE = 4000
MAX_UNLABELLED = 12000
#: The same for each of the two samples in bytes of text.
MAX_TEXT_BYTES = 1 << 26
MAX_FEATURES = 8192
#: A feature that fewer documents of P and fewer of U have isn't looked at.
LEAST_P, LEAST_U = 2, 15
HASH_BITS = 22
#: ROUNDS, L1, LEAST_RATIO, LEAST_P, LEAST_U, MAX_FEATURES and HASH_BITS have the least cross-validated error on the training
#: rows of two tables, see the README.
ROUNDS = 400
L1 = 3e-4
#: Twice the log likelihood ratio (P and U differ against don't) from which a feature is kept.
LEAST_RATIO = 10
#: Words whose scores a worker remembers.
CACHE = 400_000

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Distinct runs of letters, A-Z lower-cased; all that is not ASCII counts as a letter."""
    return set((text or "").encode("utf-8", "replace").translate(_LETTERS).split())


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its beginnings of 4, 5 and 6 bytes."""
    mask = (1 << HASH_BITS) - 1
    return [zlib.crc32(word) & mask, *(zlib.crc32(b"^%d" % n + word[:n]) & mask for n in (4, 5, 6) if len(word) > n)]


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def word(self, word: bytes) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))


def risk_gradient(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """d risk / d score for P and U, and the risk, with the logistic loss. Where the estimate of the clean class's risk is
    negative, only that part is followed, upwards, as it shows overfitting."""
    s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
    clean = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    risk = prior * np.logaddexp(0, -z_p).mean() + max(0.0, clean)
    if clean >= 0:
        return prior * (s_p - 1) / len(z_p) - prior * s_p / len(z_p), s_u / len(z_u), risk
    return prior * s_p / len(z_p), -s_u / len(z_u), risk


def _log_ratio(k_p: np.ndarray, n_p: int, k_u: np.ndarray, n_u: int) -> np.ndarray:
    """Twice the log likelihood ratio of rates of their own against one rate for k_p of n_p and k_u of n_u documents."""
    rate = np.clip((k_p + k_u) / (n_p + n_u), 1e-12, 1 - 1e-12)
    part = lambda k, e: k * np.log(np.maximum(k, 1e-12) / e)
    return 2 * (part(k_p, n_p * rate) + part(n_p - k_p, n_p * (1 - rate)) + part(k_u, n_u * rate) + part(n_u - k_u, n_u * (1 - rate)))


def _document_counts(docs: list[np.ndarray]) -> np.ndarray:
    """In how many documents each feature occurs, counted one document after the other: no copy of all is made."""
    out = np.zeros(1 << HASH_BITS, np.int32)
    for d in docs:
        out[np.unique(d)] += 1
    return out


def _slices(docs: Iterable[np.ndarray], entries: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The documents' places in slices of about ``entries``, so that a step's work arrays stay small: numbers of the documents
    that have any, where each one's begin, how many they are, and the places."""
    own: list[int] = []
    cols: list[np.ndarray] = []

    def slice_():
        sizes = np.fromiter(map(len, cols), np.int64, len(cols))
        return np.array(own), np.cumsum(sizes) - sizes, sizes, np.concatenate(cols)

    n = 0
    for i, c in enumerate(docs):
        if len(c):
            own.append(i)
            cols.append(c)
            n += len(c)
        if n >= entries:
            yield slice_()
            own, cols, n = [], [], 0
    if cols:
        yield slice_()


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = ROUNDS, l1: float = L1, least_ratio: float = LEAST_RATIO, most: int = MAX_FEATURES, least_p: int = LEAST_P, least_u: int = LEAST_U) -> Model:
    """positive, unlabelled: feature numbers of each document, repeats counted. Without positives the score is the prior
    everywhere."""
    if not positive or not unlabelled:
        return _prior_only(prior)
    df_p, df_u = _document_counts(positive), _document_counts(unlabelled)
    seen = np.flatnonzero((df_p >= least_p) | (df_u >= least_u))
    worth = _log_ratio(df_p[seen].astype(float), len(positive), df_u[seen].astype(float), len(unlabelled))
    best = np.argsort(-worth, kind="stable")[:most]
    chosen = np.sort(seen[best[worth[best] > least_ratio]])
    return fit_places([_places(d, chosen) for d in positive], [_places(d, chosen) for d in unlabelled], chosen, prior, rounds, l1)


def _prior_only(prior: float) -> Model:
    prior = min(max(prior, 1e-4), 0.9)
    return Model({}, float(np.log(prior / (1 - prior))))


def _kind(chosen: np.ndarray) -> type:
    """The integers that hold a place in chosen."""
    return np.int16 if len(chosen) <= 1 << 15 else np.int32


def _places(d: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Where in chosen (ascending) the features of a document stand, repeats counted; the others are left out."""
    at = np.searchsorted(chosen, d)
    return (at[chosen[np.minimum(at, len(chosen) - 1)] == d] if len(chosen) else at[:0]).astype(_kind(chosen))


def fit_places(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float, rounds: int = ROUNDS, l1: float = L1) -> Model:
    """As :func:`fit`, from the places of each document's features in the chosen ones; a document may have none."""
    if not positive or not unlabelled or not len(chosen):
        return _prior_only(prior)
    prior = min(max(prior, 1e-4), 0.9)
    n_p, n = len(positive), len(positive) + len(unlabelled)
    parts = list(_slices(chain(positive, unlabelled)))
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.full(n, b)
        for own, starts, _, col in parts:
            z[own] += np.add.reduceat(w[col], starts)
        g_p, g_u, _ = risk_gradient(z[:n_p], z[n_p:], prior)
        g = np.concatenate([g_p, g_u])
        gw, gb = np.zeros(len(chosen)), g.sum()
        for own, _, sizes, col in parts:
            gw += np.bincount(col, np.repeat(g[own], sizes), len(chosen))
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 + t / 200)
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        step = rate / (np.sqrt(v / c2) + 1e-8)
        w = w - step * (m / c1)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model({int(f): float(x) for f, x in zip(chosen, w, strict=True) if x}, float(b))


def cross_validated(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, settings: list[dict], folds: int = 4) -> tuple[dict, list[float]]:
    """The settings of fit with the least error on folds left out, and the error of each; the first of those that tie.

    The error needs no clean labels: 2 * prior * (share of P called clean) + (share of U called toxic) - prior.
    """
    errors = []
    for own in settings:
        missed = called = 0.0
        for k in range(folds):
            model = fit([d for i, d in enumerate(positive) if i % folds != k], [d for i, d in enumerate(unlabelled) if i % folds != k], prior, **own)
            above = lambda docs, m=model: sum(m.bias + sum(m.weights.get(int(f), 0.0) for f in d) >= 0 for d in docs)
            missed += len(positive[k::folds]) - above(positive[k::folds])
            called += above(unlabelled[k::folds])
        errors.append(2 * prior * missed / len(positive) + called / len(unlabelled) - prior)
    return settings[int(np.argmin(errors))], errors


def drawn(docs: DataFrame, bound: int, text_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """About ``bound`` distinct rows of docs (doc_id, text) and ``text_bytes`` of text at most, drawn by a hash of both columns.
    Equal rows are drawn together and count once, so the sample depends on the rows alone, not on where they lie."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, bound / max(1, rows), text_bytes / max(1, size))
    return docs.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()


def _numbers(docs: DataFrame) -> DataFrame:
    """(f): the feature numbers of each document that has any; a feature counts once for each distinct word that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = [[f for w in words_of(t.as_py()) for f in features(w)] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n in numbers if n], pa.list_(pa.int32()))], names=["f"])

    return docs.select("text").mapInArrow(run, "f array<int>")


def _chosen(p: DataFrame, u: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The features that :func:`fit` chooses, ascending. They are counted and ranked in tasks; MAX_FEATURES at most are collected."""
    each = [d.select(F.explode(F.array_distinct("f")).alias("f"), F.lit(own).alias("p")) for d, own in ((p, 1), (u, 0))]
    counts = each[0].unionByName(each[1]).groupBy("f").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            worth = _log_ratio(b.column(1).to_numpy().astype(float), n_p, b.column(2).to_numpy().astype(float), n_u)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(worth)], names=["f", "worth"])

    ranked = counts.where((F.col("p") >= LEAST_P) | (F.col("u") >= LEAST_U)).mapInArrow(run, "f int, worth double").where(F.col("worth") > LEAST_RATIO)
    return np.array(sorted(r["f"] for r in ranked.orderBy(F.desc("worth"), "f").limit(MAX_FEATURES).collect()), np.int32)


def _collected(numbers: DataFrame, chosen: np.ndarray) -> list[np.ndarray]:
    """The places of each document's features in the chosen ones; what isn't chosen stays in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_places(d.values.to_numpy(), chosen).tobytes() for d in b.column(0)], pa.binary())], names=["c"])

    return [np.frombuffer(r["c"], _kind(chosen)) for r in numbers.mapInArrow(run, "c binary").collect()]


def train(docs: DataFrame, labels: DataFrame, held_out=None, positives: int = MAX_POSITIVE, unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learns from rows of docs and labels whose id is not held out (crc32 of the id mod 5 is 0).

    Null labels are ignored; an id that is labelled twice is toxic if any label says so. The class prior is the share
    of toxic among those labelled ids. P and U are drawn as in :func:`drawn`, to the bounds given.
    """
    small_batches(docs.sparkSession)
    out = id_crc32() % 5 == 0 if held_out is None else held_out
    known = labels.where("toxic is not null and doc_id is not null").where(~out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "labels")
    n, toxic = known.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    if not toxic:
        return Model({}, float(np.log(1e-4)))
    # At most about four times `positives` ids: a fixed bound on what is broadcast.
    some = F.pmod(F.xxhash64(F.lit("ids"), "doc_id"), F.lit(1 << 30)) < int(min(1.0, 4 * positives / toxic) * (1 << 30))
    ids = known.where("toxic = 1").where(some).select("doc_id")
    own = docs.select("doc_id", "text")
    p = drawn(own.join(F.broadcast(ids), "doc_id", "left_semi"), positives)
    u = drawn(own.where(~out), unlabelled)
    p, u = written(_numbers(p), "positive"), written(_numbers(u), "unlabelled")
    n_p, n_u = p.count(), u.count()
    if not n_p or not n_u:
        return _prior_only(toxic / n)
    chosen = _chosen(p, u, n_p, n_u)
    return fit_places(_collected(p, chosen), _collected(u, chosen), chosen, toxic / n)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep of docs, and score (0 to 1) of the whole text; null and empty texts get that of no words."""
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    schema = src.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for b in batches:
            z = np.empty(b.num_rows)
            for i, t in enumerate(b.column(b.num_columns - 1)):
                total = 0.0
                for w in words_of(t.as_py()):
                    x = cache.get(w)
                    if x is None:
                        if len(cache) >= CACHE:
                            cache.clear()
                        x = cache[w] = own.word(w)
                    total += x
                z[i] = total
            s = 1 / (1 + np.exp(-np.clip(z + own.bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=[*keep, "score"])

    return src.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learned as in :func:`train`; held-out rows are scored by a model that has not seen them. Null ids count as the empty
    id; null and empty texts get the score of no words. Texts of any length are scored whole. Repeated rows are rows of their
    own with equal scores. A score of 0.5 counts as toxic. Empty labels give a model that calls nothing toxic; an empty table
    gives no rows. Other columns are not read.
    """
    out = score(docs, train(docs, labels), ["doc_id"])
    return out.select("doc_id", (id_crc32() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under 0.5, with all their columns, whatever these are named. Null and empty texts, repeated
    rows, ties and empty tables as in :func:`toxicity`."""
    model = train(docs, labels)
    return keeping(docs, ("doc_id", "text"), lambda d, own: score(d, model, own).where("score < 0.5").select(*own))
