"""Embedding whitening: leading principal components by matrix-free block subspace iteration, one Spark pass a step.

Vectors become integers ``floor(scale * c) + shift``, so sums, means and deviations are exact. The fit list holds each integer vector
once. A step sends an orthonormal block Q to all tasks, each adds up Xᵀ(XQ) over its centred rows, and a tree adds the parts; the driver
holds arrays of dimensions x block only. QR and Rayleigh-Ritz follow; the residuals of V q - e q, measured with the same pass,
certify all components. A block whose Ritz values promise too slow a contraction is widened, at most to all dimensions, where
Rayleigh-Ritz is exact.

Odd input: rows whose vector is null, or holds a null or an entry that isn't finite, are dropped; so are vectors of another length than the
commonest (of equally common ones the longest) and vectors without entries. Entries beyond a 64-bit integer stay at its ends. Repeated rows
and null ids stay; extra columns are ignored. Components whose variance is 0 (up to rounding) have no rows, so an empty table, a single vector or copies of
one give none. A deviation beyond a 64-bit integer is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.llm import common

#: Largest residual of a certified component, as a share of the first eigenvalue.
TOLERANCE = 1e-13
#: Passes that a block may still need before it is widened instead.
PATIENCE = 12
_LONG = 1 << 63
_SAFE = float(1 << 62)
_PIECE = 22


@dataclass
class Whitening:
    """What was fitted: size and exact sums of the fit list, eigenvalues, unit components as columns, and how it went."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    residuals: np.ndarray
    widths: list[int]
    identity_error: float | None = None

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.components / np.sqrt(self.values)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id and x of the rows that remain."""
    rows = common.pick(df, vec_id=id_col, v=vector_col).where("v is not null")
    rows = rows.select("vec_id", F.col("v").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.where(finite & (F.size("v") > 0))
    whole = lambda c: F.coalesce(F.try_add(F.floor(c * scale), F.lit(shift).cast("bigint")), F.lit(_LONG - 1))
    rows = rows.select("vec_id", F.transform("v", whole).alias("x"))
    common_size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (common_size["d"] if common_size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    size = len(column.value_lengths()) and column.value_lengths()[0].as_py()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size or 0)


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """Rows minus the mean as doubles, each rounded once, and the exact sum of (n x - S)^2 of each row."""
    floor = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, floor, strict=True)]
    widest = float(np.abs(x.astype(np.float64) - np.array(floor, np.float64)).max(initial=0.0)) + 1.0
    if widest * n < _SAFE:
        y = (x - np.array(floor, np.int64)) * np.int64(n) - np.array(rest, np.int64)
    else:
        y = (x.astype(object) - np.array(floor, object)) * n - np.array(rest, object)
    if (widest * n) ** 2 * max(x.shape[1], 1) < _SAFE:
        deviation = (y * y).sum(axis=1).tolist()
    else:
        exact = ((row * row).sum() for row in y.astype(object))
        deviation = [int(d) if d < _LONG else None for d in exact]
    return y.astype(np.float64) / n, deviation


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums, each entry added up in three pieces of 22 bits or so."""
    low = np.int64((1 << _PIECE) - 1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 + 3 * dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            out[0] += len(x)
            if len(x):
                out[1:] += np.concatenate([(x >> np.int64(2 * _PIECE)).sum(axis=0), (x >> np.int64(_PIECE) & low).sum(axis=0), (x & low).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

    got = common.summed(fit.mapInArrow(part, "part binary"), "part", 1 + 3 * dims).tolist()
    high, middle, small = got[1 : 1 + dims], got[1 + dims : 1 + 2 * dims], got[1 + 2 * dims :]
    return got[0], [(h << 2 * _PIECE) + (m << _PIECE) + s for h, m, s in zip(high, middle, small, strict=True)]


def _pass(fit: DataFrame, n: int, sums: list[int], block: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q for an orthonormal block Q, and the trace of V, by one pass over the fit list."""
    dims, width = block.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trace = np.zeros((dims, width)), 0.0
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                rows, _ = centred(x, n, sums)
                out += rows.T @ (rows @ block)
                trace += float((rows * rows).sum())
        yield pa.RecordBatch.from_arrays([pa.array([np.append(out.ravel(), trace).tobytes()], pa.binary())], names=["part"])

    got = common.summed(fit.mapInArrow(part, "part binary"), "part", dims * width + 1, "float64")
    return got[:-1].reshape(dims, width) / n, float(got[-1]) / n


def fit_whitening(fit: DataFrame, dims: int, count: int = 16, seed: int = 13) -> Whitening | None:
    """The first ``count`` components of the fit list's covariance; None without any variance."""
    n, sums = _sums(fit, dims)
    if n < 2:
        return None
    random = np.random.default_rng(seed)
    wanted = min(count, dims)
    block = np.linalg.qr(random.standard_normal((dims, min(dims, 2 * wanted))))[0]
    widths, before = [], math.inf
    while True:
        image, trace = _pass(fit, n, sums, block)
        if trace <= 0.0:
            return None
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = block @ turn, image @ turn
        width = block.shape[1]
        widths.append(width)
        residuals = np.linalg.norm(image[:, :wanted] - ritz[:, :wanted] * values[:wanted], axis=0) / values[0]
        worst = float(residuals.max())
        # A complete block is exact up to rounding: what a further pass doesn't halve is the rounding itself.
        if worst <= TOLERANCE or (width == dims and worst > before / 2):
            break
        before = worst if width == dims else math.inf
        ratio = max(values[-1], 0.0) / max(values[wanted - 1], 1e-300)
        left = math.log(TOLERANCE / worst) / math.log(ratio) if 0 < ratio < 1 else math.inf if ratio >= 1 else 1.0
        if width < dims and left > PATIENCE:
            image = np.hstack([image, random.standard_normal((dims, min(width, dims - width))) * values[0]])
        block = np.linalg.qr(image if width < dims else ritz)[0]
    kept = values[:wanted] > values[0] * dims * np.finfo(float).eps * 4
    q = ritz[:, :wanted][:, kept]
    q = q / np.linalg.norm(q, axis=0)
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, values[:wanted][kept].copy(), q, trace, residuals[kept], widths)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.values)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k + 1, k))
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                w = model.project(centred(x, model.n, model.sums)[0])
                out[:k] += w.T @ w
                out[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

    got = common.summed(fit.mapInArrow(part, "part binary"), "part", (k + 1) * k, "float64").reshape(k + 1, k) / model.n
    # Rows are centred exactly, so their mean is rounding only and taking it off here loses nothing.
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    rows = integer_vectors(df, id_col, vector_col, scale, shift)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = common.cut(rows.select("x").distinct(), "fit-list")
    first = fit.select(F.size("x").alias("d")).first()
    model = fit_whitening(fit, first["d"], count) if first else None
    if model is None:
        common.drop(fit)
        return df.sparkSession.createDataFrame([], schema)
    model.identity_error = identity_error(fit, model)
    common.drop(fit)
    k, share = len(model.values), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            x = _matrix(batch.column("x"))
            plain, deviation = centred(x, model.n, model.sums)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n, np.int64)),
                pa.array(deviation, pa.int64()).take(at), pa.array(model.project(plain).ravel() if len(x) else np.zeros(0)), pa.array(np.tile(share, len(x))),
                pa.array(np.full(len(x) * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
