"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed from the rows: a pass over the fit list computes Xᵀ(XQ) for a block Q of a few columns, with
each row centred before it is multiplied. Between passes the driver works on matrices with a row per dimension only: it
orthonormalises (QR), projects (Rayleigh-Ritz) and takes the residuals ‖Vu - eu‖ of the leading pairs. It stops once
those certify all components. The blocks of earlier passes stay in the basis of the projection, up to BASIS blocks, after
which it restarts from its leading vectors; that reaches close eigenvalues in far fewer passes than the last block alone.

Entries are whole numbers, floor(64 c) + 1000000. Rows are centred exactly: a whole number near the mean is subtracted as
long, then the rest of the mean, known to double precision from exact sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

COMPONENTS = 16
#: Columns of a block beyond the components asked for.
OVERSAMPLE = 16
#: Blocks that the basis holds before it restarts.
BASIS = 4
#: A pair is certified when its residual is below this times the largest eigenvalue.
TOLERANCE = 1e-12
PASSES = 300
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on count as non-finite: their long is no longer exact as a double.
TOO_LARGE = float(1 << 46)
#: An eigenvalue below this times the largest counts as zero: there is nothing to scale along it.
FLAT = 1e-11


def as_longs(embedding: Column) -> Column:
    return F.transform(embedding.cast("array<double>"), lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """Written: vec_id and x, the long vector, of the rows whose vector is neither null nor holds null, non-finite or
    (from TOO_LARGE) unrepresentable entries. Vectors of another length than most have entries missing or too many, and
    are left out too; of lengths that are equally frequent the largest counts."""
    whole = F.forall(F.col("embedding").cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE))
    rows = embeddings.where(F.col("embedding").isNotNull() & F.coalesce(whole, F.lit(False))).select("vec_id", "embedding")
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return written(rows.where(F.size("embedding") == (size["d"] if size else 0)).select("vec_id", as_longs(F.col("embedding")).alias("x")), "whitening-rows")


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _summed(fit: DataFrame, partial: Callable[[Iterator[np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """The sum over tasks of partial(matrices of x), a flat array of ``size`` doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = partial(_matrix(b.column(0)) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out, pa.float64())], names=["cell", "v"])

    out = np.zeros(size)
    for r in fit.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # `size` rows
        out[r["cell"]] = r["v"]
    return out


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                n += len(x)
                high = high + (x >> 32).sum(axis=0)  # two halves, so that no task's sum can overflow
                low = low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            cells = np.arange(len(high) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(np.r_[high, 0]), pa.array(np.r_[low, n])], names=["cell", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = sorted(fit.mapInArrow(run, "cell int, high long, low long").groupBy("cell").agg(whole("high"), whole("low")).collect())
    sums = [(int(r["high"]) << 32) + int(r["low"]) for r in got]
    return (sums[-1], sums[:-1]) if sums else (0, [])


@dataclass
class Whitening:
    """What fit() has learned; fixed by the dimensions, whatever the rows."""

    n: int
    sums: list[int]
    #: Unit eigenvectors as columns, their eigenvalues in falling order, the covariance's trace.
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    #: Largest absolute entry of the whitened fit list's covariance minus the identity.
    identity_error: float = 0.0
    passes: int = 0

    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    def rest(self) -> np.ndarray:
        """The means minus base(), each rounded once."""
        return np.array([float(Fraction(s, self.n) - s // self.n) for s in self.sums])

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n x - S)²."""
        u, r = x - self.base(), [s % self.n for s in self.sums]
        most = (int(np.abs(u).max(initial=0)) + 1) * self.n
        if most * most * max(1, len(r)) < 1 << 62:
            return ((u * self.n - np.array(r, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((int(a) * self.n - b) ** 2 for a, b in zip(row, r, strict=True)) for row in u]


def subspace_iteration(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, oversample: int = OVERSAMPLE, tolerance: float = TOLERANCE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, int]:
    """The k leading eigenvectors and eigenvalues of a symmetric d x d operator, known by product(Q) only, and the passes
    taken. RuntimeError if ``passes`` don't certify all of them."""
    b = min(d, k + oversample)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((d, b)))[0]
    basis, image = np.empty((d, 0)), np.empty((d, 0))
    for done in range(1, passes + 1):
        basis, image = np.hstack([basis, q]), np.hstack([image, product(q)])
        h = basis.T @ image
        values, w = np.linalg.eigh((h + h.T) / 2)
        values, w = values[::-1][:b], w[:, ::-1][:, :b]
        ritz, moved = basis @ w, image @ w
        residual = moved - ritz * values
        largest = max(values[0], 0.0)
        if (np.linalg.norm(residual[:, :k], axis=0) <= tolerance * largest).all() or basis.shape[1] == d:
            return ritz[:, :k], values[:k], done
        if basis.shape[1] + b > BASIS * b:
            basis, image = ritz, moved
        for _ in range(2):  # twice, so that rounding leaves nothing of the basis
            residual = residual - basis @ (basis.T @ residual)
        u, s, _ = np.linalg.svd(residual, full_matrices=False)
        q = u[:, s > 1e-15 * max(s[0], largest)][:, : min(b, d - basis.shape[1])]
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        if not q.shape[1]:
            return ritz[:, :k], values[:k], done
    raise RuntimeError(f"residuals of {k} components are not certified after {passes} passes")


def fit(rows: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE) -> Whitening:
    """Learns from each distinct vector of rows (vec_id, x) once. Fewer components come out where the covariance has a
    lower rank, none where all vectors are equal."""
    small_batches(rows.sparkSession, 10_000)
    distinct = written(rows.select("x").distinct(), "whitening-fit")
    n, sums = exact_sums(distinct)
    d = len(sums)
    model = Whitening(n, sums, np.empty((d, 0)), np.empty(0), 0.0)
    if not d:
        return model
    base, rest = model.base(), model.rest()

    def squares(parts: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([sum(float(((x - base - rest) ** 2).sum()) for x in parts)])

    model.trace = float(_summed(distinct, squares, 1)[0]) / n
    if model.trace <= 0:
        return model

    def product(q: np.ndarray) -> np.ndarray:
        def partial(parts: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros(q.shape)
            for x in parts:
                c = x - base - rest
                out += c.T @ (c @ q)
            return out.ravel()

        return _summed(distinct, partial, q.size).reshape(q.shape) / n

    vectors, values, model.passes = subspace_iteration(product, d, min(components, d), oversample)
    full = values > FLAT * values[0]
    vectors, model.values = vectors[:, full], values[full]
    model.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    k, scaled = len(model.values), model.vectors / np.sqrt(model.values)

    def whitened(parts: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((k, k))
        for x in parts:
            z = (x - base - rest) @ scaled
            out += z.T @ z
        return out.ravel()

    model.identity_error = float(np.abs(_summed(distinct, whitened, k * k).reshape(k, k) / n - np.eye(k)).max())
    return model


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (decimal) and whitened (an entry for each component) of rows (vec_id, x)."""
    small_batches(rows.sparkSession, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rest = (model.base(), model.rest()) if model.n else (0, 0)
        k, scaled = len(model.values), model.vectors / np.sqrt(model.values)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                z = (x - base - rest) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(z.ravel()))
                deviation = pa.array(list(map(str, model.deviation(x))), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), deviation, lists], names=["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"vec_id {kind}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """transform() of the usable rows of embeddings, and the model that fit() gives for them.

    Null ids and repeated rows stay rows of their own; equal vectors count once in the fit. Rows with an unusable vector
    are left out (see usable_rows). An empty table, or one whose usable vectors are all equal, gives no components. Other
    columns are not read.
    """
    rows = usable_rows(embeddings)
    model = fit(rows, components)
    return transform(rows, model), model


def whitened_rows(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, model = whiten(embeddings, components)
    explained = F.array(*[F.lit(float(e) / model.trace) for e in model.values]) if len(model.values) else F.array().cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
