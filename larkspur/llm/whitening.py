"""Whitening of embeddings: one-pass moments, merged over partitions, and a symmetric QR eigen-solve.

Each partition reads its vectors once and keeps count, mean and the matrix of centred products,
which every vector updates by a matrix of rank one (Welford, 1962), besides exact sums. The states
are sent row of the matrix by row of the matrix, so no task gathers whole matrices of all
partitions, and are merged by the parallel update formula (Chan, Golub and LeVeque, 1979) in two
steps. Only the merged matrix, whose size is that of the vectors squared whatever the corpus,
reaches the driver. There it becomes tridiagonal by Householder reflections and diagonal by
implicit QR steps with Wilkinson's shift."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, free_name, table

COMPONENTS = 8
#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: States of the first step of merging.
BUCKETS = 64
_HALF = 31
_STATE = "dims int, i int, n long, high long, low long, mean array<double>, products array<double>"


def vectors(column: pa.Array, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows, their vectors) for each length of vector in an Arrow column, without null
    vectors and those with null or non-finite entries. whole: as the integers x; entries from
    2^61 on, which could leave a long, count as non-finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    if whole:
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(flat * SCALE)
    bad = np.r_[0, np.cumsum(~(np.abs(flat) < (2.0**61 if whole else math.inf)))]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    good = (lengths > 0) & (bad[ends] == bad[starts])
    for d in np.unique(lengths[good]).tolist():
        at = np.flatnonzero(good & (lengths == d))
        own = flat[starts[at][:, None] + np.arange(d)]
        yield at, own.astype(np.int64) + SHIFT if whole else own


class Welford:
    """Count, mean, centred products and exact sums (in two halves) of vectors of one length."""

    def __init__(self, dims: int):
        self.n, self.mean, self.products = 0, np.zeros(dims), np.zeros((dims, dims))
        self.high, self.low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)

    def add(self, rows: np.ndarray) -> None:
        if rows.dtype == np.int64:
            self.high += (rows >> _HALF).sum(axis=0)
            self.low += (rows & ((1 << _HALF) - 1)).sum(axis=0)
        mean, products, step = self.mean, self.products, np.empty_like(self.products)
        for n, row in enumerate(rows.astype(np.float64), self.n + 1):
            off = row - mean
            np.multiply((off * ((n - 1) / n))[:, None], off, out=step)
            products += step
            mean += off / n
        self.n += len(rows)


def _states(column: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Welford] = {}
        for batch in batches:
            for _, rows in vectors(batch.column(column), whole):
                d = rows.shape[1]
                own.setdefault(d, Welford(d)).add(rows)
        for d, s in own.items():
            frame = {"dims": [d] * d, "i": range(d), "n": [s.n] * d, "high": s.high, "low": s.low, "mean": [s.mean] * d, "products": list(s.products)}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(frame.values(), kinds, strict=True)], names=list(frame))

    return run


def _merged(states: pd.DataFrame) -> pd.DataFrame:
    """One row of the matrix of centred products, from that row in several states."""
    i, n, mean, products = int(states["i"].iloc[0]), 0, 0.0, 0.0
    for m, other, own in zip(states["n"].tolist(), states["mean"], states["products"], strict=True):
        off = np.asarray(other) - mean
        products = products + np.asarray(own) + off[i] * off * (n * m / (n + m))
        mean = mean + off * (m / (n + m))
        n += m
    return pd.DataFrame({"dims": states["dims"].iloc[:1], "i": i, "n": n, "high": states["high"].sum(), "low": states["low"].sum(), "mean": [mean], "products": [products]})


@dataclass
class Moments:
    n: int
    sums: list[int]
    mean: np.ndarray
    covariance: np.ndarray


def moments(rows: DataFrame, column: str, whole: bool = True) -> Moments | None:
    """Count, exact sums (of the integers x), mean and covariance (divisor n) of the vectors of a
    column; None if there are none. Vectors of the commonest length count (of those the longest)."""
    states = rows.select(column).mapInArrow(_states(column, whole), _STATE)
    for keys in (("dims", "i", "bucket"), ("dims", "i")):
        states = states.withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(BUCKETS))).groupBy(*keys).applyInPandas(_merged, _STATE)
    states = checkpoint(states)
    top = states.where("i = 0").orderBy(F.desc("n"), F.desc("dims")).select("dims").first()
    if top is None:
        return None
    own = sorted(states.where(F.col("dims") == top[0]).collect(), key=lambda r: r.i)  # as many rows as a vector has entries
    n, products = own[0].n, np.array([r.products for r in own])
    sums = [(r.high << _HALF) + r.low for r in own]
    return Moments(n, sums, np.array(own[0].mean), (products + products.T) / (2 * n))


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and the rows of Q' with a = Q T Q', by Householder reflections."""
    a, d = np.array(a, np.float64), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        norm = math.sqrt(v @ v)
        if norm == 0:
            continue
        alpha = -math.copysign(norm, v[0])
        v[0] -= alpha
        v /= math.sqrt(v @ v)
        part = a[k + 1 :, k + 1 :]
        w = part @ v
        w -= (v @ w) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = alpha
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows."""
    diag, side, q = tridiagonal(a)
    least = np.finfo(np.float64).eps
    floor = least * least * (np.abs(diag).max(initial=0) + np.abs(side).max(initial=0))
    high, steps = len(diag) - 1, 0
    while high > 0:
        side[np.abs(side) <= least * (np.abs(diag[:-1]) + np.abs(diag[1:])) + floor] = 0
        while high > 0 and side[high - 1] == 0:
            high -= 1
        if high == 0:
            break
        low = high - 1
        while low > 0 and side[low - 1] != 0:
            low -= 1
        steps += 1
        if steps > 60 * len(diag):
            raise ArithmeticError("the QR steps did not converge")
        half, b = (diag[high - 1] - diag[high]) / 2, side[high - 1]
        shift = diag[high] - b * b / (half + math.copysign(math.hypot(half, b), half))
        x, z = diag[low] - shift, side[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, -z / r) if r else (1.0, 0.0)
            if k > low:
                side[k - 1] = r
            first, second, across = diag[k], diag[k + 1], side[k]
            diag[k] = c * c * first - 2 * c * s * across + s * s * second
            diag[k + 1] = s * s * first + 2 * c * s * across + c * c * second
            side[k] = c * s * (first - second) + (c * c - s * s) * across
            if k + 1 < high:
                x, z = side[k], -s * side[k + 1]
                side[k + 1] *= c
            q[k], q[k + 1] = c * q[k] - s * q[k + 1], s * q[k] + c * q[k + 1]
    order = np.argsort(-diag, kind="stable")
    return diag[order], q[order]


@dataclass
class Model:
    """n and sums of the fit list, the leading axes (rows), their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of all usable vectors of ``rows``; None if there are none. Directions without
    variance (by rounding) have no whitened values and are left out."""
    found = moments(rows, column)
    if found is None:
        return None
    values, axes = symmetric_qr(found.covariance)
    top = values[0] if len(values) else 0.0
    k = min(components, int((values > max(top, 0) * len(values) * 4 * np.finfo(np.float64).eps).sum()))
    trace = float(np.trace(found.covariance))
    return Model(found.n, found.sums, axes[:k], values[:k], values[:k] / trace if trace else values[:k])


def _deviations(off: np.ndarray) -> pa.Array:
    """Exact sums of squares of the rows."""
    if off.dtype == np.int64 and int(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2**63:
        return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
    totals = [sum(v * v for v in row) for row in off.tolist()]
    return pa.array([Decimal(t) if t < 10**38 else None for t in totals], pa.decimal128(38, 0))


def whiten(rows: DataFrame, model: Model | None, column: str = "embedding") -> DataFrame:
    """Adds to each usable row of ``rows``: deviation decimal(38,0), the exact sum over dimensions of
    (n * x - S)^2 (null from 10^38 on), and whitened array<double>, one entry a component.

    Rows go whose vector is null, empty, of another length than the model's, or holds null or
    non-finite entries. Equal rows stay, each with its own values; null ids and further columns pass
    through; columns of these names are replaced. Without a model (no usable vector) or with an
    empty table there are no rows."""
    to = free_name(rows)
    kind = "struct<deviation: decimal(38,0), whitened: array<double>>"
    dims = len(model.sums) if model else 0

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        n, sums = model.n, model.sums
        deviation, white = pa.nulls(0, pa.decimal128(38, 0)), np.empty((0, len(model.axes)))
        place = np.full(len(column), -1)
        for at, x in vectors(column, whole=True):
            if x.shape[1] != dims:
                continue
            most = max(int(np.abs(x).max()) * n, max(map(abs, sums)))
            off = n * x - np.array(sums, np.int64) if most < 2**61 else np.array([[n * v - s for v, s in zip(row, sums, strict=True)] for row in x.tolist()], object)
            deviation, white = _deviations(off), (off.astype(np.float64) / n) @ (model.axes / np.sqrt(model.values)[:, None]).T
            place[at] = np.arange(len(at))
        take = pa.array(place, mask=place < 0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
        return pa.StructArray.from_arrays([deviation.take(take), lists.take(take)], ["deviation", "whitened"], mask=pa.array(place < 0))

    kept = rows.drop(*(c for c in ("deviation", "whitened") if c != column))
    if model is None:
        done = kept.limit(0).withColumn(to, F.lit(None).cast(kind))
    else:
        done = kept.withColumn(to, run(F.col(column))).where(F.col(to).isNotNull())
    return done.select(*(f"`{c}`" for c in kept.columns), F.col(to)["deviation"].alias("deviation"), F.col(to)["whitened"].alias("whitened"))


def identity_error(whitened: DataFrame) -> float | None:
    """The largest absolute entry of the whitened values' covariance minus the identity, measured on
    the values themselves in a pass of its own."""
    found = moments(whitened, "whitened", whole=False)
    return None if found is None else float(np.abs(found.covariance - np.eye(len(found.covariance))).max())


def components_of(rows: DataFrame, components: int = COMPONENTS, column: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row for each usable row of ``rows`` and component: the id, component (from 1), n, deviation
    (null beyond a long), whitened, explained, identity_error. Other columns are dropped."""
    own = rows.select(id_col, column)
    model = fit(own, column, components)
    white = whiten(own, model, column)
    error = identity_error(white) if model else None
    shares = F.array(*(F.lit(float(x)) for x in model.explained)) if model else F.array().cast("array<double>")
    out = white.select(id_col, F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
