"""Whitening of embeddings: a randomised range finder with power passes over all centred rows, Rayleigh-Ritz for the components.

Entries become integers, floor(scale * entry) + shift, so that counts, sums and each row's deviation are exact. A pass multiplies the
covariance V with a few directions Q: each task adds up x (x Q) over its centred rows, the sums are added per entry by Spark, and the
driver holds matrices of dimension times directions, whatever the number of rows. Directions start random, with some to spare; each
pass gives the Ritz values and vectors of their span and the residuals |V c - e c|. Where these stay too large after some passes, the
span is doubled, up to the full dimension, where the span holds everything and one pass gives all components to double precision.

Defined results: rows whose vector is null or holds a null, a NaN or an infinity are left out everywhere; a shorter vector counts as
ending in zeros; entries beyond 2**52 / scale count as that; directions without variance (an eigenvalue below 1e-11 of the largest,
so all where there is one row or only equal ones) are no components; of equal eigenvalues any basis of their space is taken; the
largest entry of a component is positive; deviation is null where it exceeds a long; rows that repeat an id are separate rows; an
empty table gives no rows; columns named like a result are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries worked on at once in a task.
AT_ONCE = 1 << 20
#: Integers of vectors stay within doubles.
MOST = float(1 << 52)
#: An eigenvalue below this share of the largest is rounding.
RANK = 1e-11


class Grid(NamedTuple):
    """How entries become integers."""

    scale: int = 64
    shift: int = 1_000_000


class Basis(NamedTuple):
    """What whitening needs, and the check of it."""

    n: int
    sums: list[int]
    components: np.ndarray  # a column each
    variances: np.ndarray
    explained: np.ndarray
    residual: float
    span: int
    passes: int


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows take part, how many entries each row has, and all entries one behind the other."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(flat)]
    keep = column.is_valid().to_numpy(zero_copy_only=False)
    keep[bad] = False
    return keep, sizes, flat


def integers(column: pa.Array, dims: int, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their integers; missing entries count as zeros."""
    keep, sizes, flat = entries(column)
    full = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = keep[row]
    place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[inside]
    full[row[inside], place] = flat[inside]
    with np.errstate(over="ignore"):
        return keep, np.clip(np.floor(grid.scale * full[keep]), -MOST, MOST).astype(np.int64) + grid.shift


def parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, AT_ONCE // max(dims, 1))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def totals(vectors: DataFrame, grid: Grid) -> tuple[int, list[int]]:
    """Number of rows that take part, and the sums of their integers per dimension; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows, sums = 0, [], []
        for batch in parts(batches, 1 << 10):
            column = batch.column(0)
            dims = max(pc.max(pc.list_value_length(column)).as_py() or 0, len(sums))
            keep, x = integers(column, dims, grid)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)[keep]
            n += len(x)
            rows += [0] * (dims - len(rows))
            sums += [0] * (dims - len(sums))
            for j in range(int(sizes.max(initial=0))):
                has = sizes > j
                rows[j] += int(has.sum())
                sums[j] += int(x[has, j].sum())  # 1024 values below 2**53
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array([n, *rows], pa.int64()), pa.array([Decimal(0), *map(Decimal, sums)], pa.decimal128(38, 0))], names=["dim", "n", "total"])

    found = {r.dim: r for r in vectors.mapInArrow(run, "dim int, n bigint, total decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    n = found[-1].n if -1 in found else 0
    dims = max((d + 1 for d, r in found.items() if d >= 0 and r.n), default=0)
    return n, [int(found[j].total) + (n - found[j].n) * grid.shift for j in range(dims)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """Rows less their mean, and each row's sum of squares of n * x - sums (None beyond a long)."""
    if not x.size:
        return x.astype(float), [0] * len(x)
    far = n * int(np.abs(x).max()) + max(map(abs, sums))
    if far < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        if int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63:
            return d / n, (d * d).sum(axis=1).tolist()
        d = d.astype(object)
    else:
        d = n * x.astype(object) - np.array(sums, object)
    square = [int(s) for s in (d * d).sum(axis=1)]
    return (d / n).astype(float), [s if s < 1 << 63 else None for s in square]


def summed(vectors: DataFrame, dims: int, grid: Grid, work) -> dict[int, np.ndarray]:
    """Row number to the sum over all tasks of that row of `work(integers)`, a matrix for each part of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in parts(batches, dims):
            _, x = integers(batch.column(0), dims, grid)
            if len(x):
                total = work(x) if total is None else total + work(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    each = vectors.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    found = each.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {i: np.zeros(1 + max(r.j for r in found)) for i in {r.i for r in found}}
    for r in found:
        out[r.i][r.j] = r.v
    return out


def multiply(vectors: DataFrame, n: int, sums: list[int], grid: Grid, q: np.ndarray | None) -> tuple[np.ndarray, float]:
    """The covariance times q (times the identity if None), and the covariance's trace, by one pass over all rows."""
    dims = len(sums)
    sent = None if q is None else vectors.sparkSession.sparkContext.broadcast(q)

    def work(x: np.ndarray) -> np.ndarray:
        c, _ = centred(x, n, sums)
        z = c.T @ (c if sent is None else c @ sent.value)
        return np.vstack([z, np.full(z.shape[1], (c * c).sum())])

    found = summed(vectors, dims, grid, work)
    if sent is not None:
        sent.unpersist()
    return np.array([found[i] for i in range(dims)]) / n, float(found[dims][0]) / n


def orthonormal(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a)[0]


def fit(vectors: DataFrame, vector_col: str = "embedding", most: int = 32, spare: int = 10, passes: int = 3, tolerance: float = 1e-12, grid: Grid = Grid(), seed: int = 12) -> Basis:
    """The first `most` components of all rows. `tolerance` bounds residuals against the largest eigenvalue below the full dimension."""
    rows = vectors.select(F.col(f"`{vector_col}`").alias("v"))
    n, sums = totals(rows, grid)
    dims = len(sums)
    if not dims:
        return Basis(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0, 0, 0)
    rng = np.random.default_rng(seed)
    span, done = min(dims, most + spare), 0
    q = orthonormal(rng.standard_normal((dims, span)))
    while True:
        for _ in range(passes if span < dims else 1):
            z, trace = multiply(rows, n, sums, grid, q if span < dims else None)
            done += 1
            basis = q if span < dims else np.eye(dims)
            inner = basis.T @ z
            values, turn = np.linalg.eigh((inner + inner.T) / 2)
            values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
            components = basis @ turn
            residual = float(np.linalg.norm(z @ turn - components * values, axis=0).max() / max(values[0], np.finfo(float).tiny))
            if span == dims or residual <= tolerance:
                break
            q = orthonormal(z)
        if span == dims or residual <= tolerance:
            break
        span = min(dims, 2 * span)
        q = orthonormal(np.hstack([q, rng.standard_normal((dims, span - q.shape[1]))]))
    some = values > RANK * max(values[0], 0)
    values, components = values[some], components[:, some]
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(values))])
    return Basis(n, sums, components, values, values / trace if trace else values, residual, span, done)


def identity_error(vectors: DataFrame, basis: Basis, vector_col: str = "embedding", grid: Grid = Grid()) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by one more pass over all rows."""
    k = len(basis.variances)
    if not k:
        return 0.0
    n, sums, to = basis.n, basis.sums, basis.components / np.sqrt(basis.variances)

    def work(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums)[0] @ to
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = summed(vectors.select(F.col(f"`{vector_col}`").alias("v")), len(sums), grid, work)
    mean = found[k] / n  # of rows centred already, so rounding is all it takes off
    return float(np.abs(np.array([found[i] for i in range(k)]) / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, basis: Basis, vector_col: str = "embedding", grid: Grid = Grid(), carry: list[str] | None = None) -> DataFrame:
    """The rows that take part with their columns `carry` (all by default), deviation (the sum over dimensions of (n * x - sum)**2) and
    whitened (the centred row on each component, over the square root of its eigenvalue)."""
    n, sums, to = basis.n, basis.sums, basis.components / np.sqrt(basis.variances)
    passed = [c for c in (vectors.columns if carry is None else carry) if c.lower() not in ("deviation", "whitened")]
    rows = vectors.select(F.col(f"`{vector_col}`").alias("__v"), *[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(passed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, len(sums)):
            keep, x = integers(batch.column(0), len(sums), grid)
            c, deviation = centred(x, n, sums)
            flat = (c @ to).ravel() if sums else np.zeros(0)
            w = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * to.shape[1], pa.int32()), pa.array(flat))
            some = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(deviation, pa.int64()), w], names=[*some.schema.names[1:], "deviation", "whitened"])

    schema = "".join(f"`__{k}` {vectors.schema[c].dataType.simpleString()}, " for k, c in enumerate(passed))
    out = rows.mapInArrow(run, schema + "deviation bigint, whitened array<double>")
    return out.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(passed)], "deviation", "whitened")
