"""Whitening of embeddings with eigenvectors that are refined from single to double precision.

1. Rows whose vector is null, of another length than most, or holds a null or non-finite entry are left out. The rest becomes whole
   numbers, x = floor(64 * c) + 1,000,000, and the fit list holds each x vector once (`distinct`, summed where the rows are,
   so a vector that a third of the rows share is one row a task).
2. Sums and covariance are gathered by Spark. Each task centres its rows to the nearest whole number and multiplies them block
   by block; products of whole numbers below 2 ** 53 are exact in doubles, so the covariance does not depend on the order
   or on tasks that ran again. What rounding the centre left out is subtracted at the end, a square of half a unit at most.
3. The driver has the d x d covariance and no rows. Eigenvectors in float32 start the Ogita-Aishima iteration: only matrix
   products, in doubles and at last in extended precision, each round squaring the error. Where eigenvalues lie too close for
   the iteration, those of a cluster are separated by a small symmetric problem of their own (sub-solve).
4. Rows are projected where they are. How far the whitened covariance is from the identity is measured over the fit list.

Rows with the same x vector, repeated ids and null ids are kept as they are. Components without variance have whitened null. An empty
table, or one without a usable vector, gives an empty one. Vectors of two lengths raise an error unless `dim` says which to keep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
#: Entries of more than so many whole steps from zero do not fit; such vectors are left out.
WIDEST = float(1 << 52)
#: Rows of a block that a task multiplies at once.
BLOCK = 4096


def wholes(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """x of a column of vectors, and which rows have one: null and empty vectors, and those with null, non-finite or too large
    entries, have none. A null entry becomes NaN on its way out of Arrow."""
    sizes = np.diff(column.offsets.to_numpy())
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~(np.abs(c) * SCALE <= WIDEST)
    ends = np.cumsum(sizes)
    bad_before = np.r_[0, np.cumsum(bad)]
    fine = (sizes > 0) & (bad_before[ends] == bad_before[ends - sizes]) & ~column.is_null().to_numpy(zero_copy_only=False)
    x = np.floor(np.where(bad, 0, c) * SCALE).astype(np.int64) + SHIFT
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(x)), fine


def _usable(dim: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, fine = wholes(b.column(0))
            if dim is not None:
                fine &= np.diff(x.offsets.to_numpy()) == dim
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(fine))], names=["x"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of dim whole numbers each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch], name: str, dim: int) -> Iterator[np.ndarray]:
    for b in batches:
        for k in range(0, b.num_rows, BLOCK):
            yield _matrix(b.column(name).slice(k, BLOCK), dim)


def _products(centre: np.ndarray):
    """Sums of y and of y y' over a task's rows, y = x - centre, a row for each dimension."""
    dim = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1, dim)), 0
        for x in _blocks(batches, "x", dim):
            y = (x - centre).astype(np.float64)
            total[:dim] += y.T @ y
            total[dim] += y.sum(0)
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    return run


def _sums(dim: int):
    """Exact sums of a task's rows, a row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for x in _blocks(batches, "x", dim):
            # a block's sum fits a long unless entries are huge
            sums = x.sum(0) if np.abs(x).max(initial=0) < 2**50 else x.astype(object).sum(0)
            total = [t + int(v) for t, v in zip(total, sums)]
            n += len(x)
        whole = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), whole], names=["i", "n", "s"])

    return run


def moments(fit: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums S (whole numbers) and covariance of fit(x), which the driver gets as d and d x d numbers."""
    sums = fit.mapInArrow(_sums(dim), "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # dim rows
    n, s = sums[0].n, [int(r.s) for r in sorted(sums, key=lambda r: r.i)]
    centre = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    rows = fit.mapInArrow(_products(centre), "i int, v array<double>")
    got = rows.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()  # dim + 1 rows
    products = np.array([r.v for r in sorted(got, key=lambda r: r.i)])
    left = products[dim] / n
    v = products[:dim] / n - np.outer(left, left)
    return n, np.array(s, object), (v + v.T) / 2


def refine(a: np.ndarray, x: np.ndarray, dtype=np.float64) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: (x, eigenvalues, size of the correction), by matrix products in dtype."""
    a, x = a.astype(dtype), x.astype(dtype)
    r = np.eye(len(a), dtype=dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # rounding that is not symmetric would be divided by small gaps
    lam = np.diag(s) / (1 - np.diag(r))
    d = np.diag(lam)
    delta = 2 * (np.linalg.norm((s - d).astype(np.float64)) + np.linalg.norm(a.astype(np.float64)) * np.linalg.norm(r.astype(np.float64)))
    gap = lam[None, :] - lam[:, None]
    apart = np.abs(gap) > delta
    e = np.where(apart, (s + lam[None, :] * r) / np.where(apart, gap, 1), r / 2)
    x = x + x @ e
    # eigenvalues too close for the quotient: the step made these columns orthonormal, a problem of their size turns them
    order = np.argsort(lam, kind="stable")
    for cluster in np.split(order, np.flatnonzero(np.diff(lam[order]) > delta) + 1):
        if len(cluster) > 1:
            v = x[:, cluster]
            centre = lam[cluster].mean()
            small = v.T @ (a @ v - centre * v)
            x[:, cluster] = v @ np.linalg.eigh(((small + small.T) / 2).astype(np.float64))[1].astype(dtype)
    return x, lam, float(np.abs(e).max(initial=0))


def eigen(v: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    size = np.abs(v).max(initial=0) or 1.0
    a = v / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    last = np.inf
    for _ in range(rounds):
        x, _, step = refine(a, x)
        if step < 1e-14 or step >= last < 1e-9:
            break
        last = step
    # what doubles cannot see any more
    for _ in range(2):
        x, lam, _ = refine(a, x, np.longdouble)
    lam = np.einsum("ij,ij->j", x, a.astype(np.longdouble) @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-lam, kind="stable")
    x = x[:, order] / np.sqrt(np.einsum("ij,ij->j", x, x))[order]
    return (lam[order] * size).astype(np.float64), x.astype(np.float64)


@dataclass
class Whitening:
    """What projecting needs: n, sums S, the first components' weights (d x k, divided by sqrt(e)), shares of variance."""

    n: int
    sums: np.ndarray
    weights: np.ndarray
    explained: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part is taken off in whole numbers, so nothing cancels."""
        mean = [divmod(int(s), self.n) for s in self.sums]
        return (x - np.array([q for q, _ in mean], np.int64)).astype(np.float64) - np.array([r / self.n for _, r in mean])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.weights

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2, null where they pass a long."""
        near = ((self.centred(x) * self.n) ** 2).sum(1)
        if near.max(initial=0) < 2**62:
            return ((x * self.n - self.sums.astype(np.int64)) ** 2).sum(1).tolist()
        exact = ((x.astype(object) * self.n - self.sums) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]


def fit_whitening(fit: DataFrame, dim: int, components: int = 16) -> Whitening:
    """From the fit list fit(x). A component whose variance is nothing but rounding gets weights of NaN."""
    n, sums, v = moments(fit, dim)
    e, vectors = eigen(v)
    trace = float(np.trace(v))
    real = e > max(trace, 0) * 1e-13
    weights = np.where(real, vectors / np.sqrt(np.where(real, e, 1)), np.nan)[:, :components]
    return Whitening(n, sums, weights, (np.where(real, e, 0) / (trace or 1))[:components])


def _whitened_products(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.weights.shape[1]
        total = np.zeros((k + 1, k))
        for x in _blocks(batches, "x", model.dim):
            w = model.project(x)
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    return run


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, over components that have variance."""
    rows = fit.mapInArrow(_whitened_products(model), "i int, v array<double>")
    got = rows.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()  # components + 1 rows
    products = np.array([r.v for r in sorted(got, key=lambda r: r.i)]) / model.n
    k = model.weights.shape[1]
    real = np.flatnonzero(~np.isnan(model.weights[0]))
    cov = (products[:k] - np.outer(products[k], products[k]))[np.ix_(real, real)]
    return float(np.abs(cov - np.eye(len(real))).max(initial=0))


def _project(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, fine = wholes(b.column("embedding"))
            fine = pa.array(fine & (np.diff(x.offsets.to_numpy()) == model.dim))
            ids, x = b.column("vec_id").filter(fine), x.filter(fine)
            for k in range(0, len(x), BLOCK):
                part = _matrix(x.slice(k, BLOCK), model.dim)
                w = model.project(part)
                offsets = pa.array(np.arange(len(part) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(k, BLOCK), pa.array(model.deviation(part), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["vec_id", "deviation", "w"])

    return run


def whiten(embeddings: DataFrame, components: int = 16, dim: int | None = None) -> DataFrame:
    """embeddings(vec_id, embedding) -> a row for each usable row and component: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error."""
    spark = embeddings.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fit = stored(rows.select("embedding").mapInArrow(_usable(dim), "x array<long>").distinct(), "whitening-fit")
    sizes = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if sizes[0] is None:
        return spark.createDataFrame([], out)
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} entries: say which length to keep")
    model = fit_whitening(fit, sizes[0], components)
    error = identity_error(fit, model)
    told = rows.mapInArrow(_project(model), "vec_id long, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("k", "w"))
    share = F.element_at(F.array(*[F.lit(float(v)) for v in model.explained]), F.col("k") + 1)
    return told.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.nanvl("w", F.lit(None).cast("double")).alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error"))
