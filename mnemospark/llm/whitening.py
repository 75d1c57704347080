"""Whitening of embeddings by a compensated covariance.

Sums of products of nearly equal vectors lose the digits that matter, so every sum here is kept
as a high and a low double (some 106 bits).  A task cuts its centred vectors, column by column, into
slices of SLICE bits: products of two slices, summed over a block of rows, are whole
numbers below 2^53, so each matrix product of slices is free of error; these are added to the task's
high and low parts by error-free sums, and the parts of all tasks are merged in the same way.
The d x d result is all that reaches the driver, where LAPACK reduces it to tridiagonal
form and solves that by divide and conquer; two steps in extended precision then refine the vectors
with the low parts too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import width, written

#: Bits of a slice, slices of a vector, and rows of a block: 2 SLICE bits and a block's rows stay within 53.
SLICE, SLICES, BLOCK = 20, 4, 1 << 13
LONG = (1 << 63) - 1


def finite(vector: str):
    """Whether a vector is there, has entries, and all of them are finite."""
    v = F.col(vector)
    inside = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & inside, F.lit(False))


def sized(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose vector is finite and as long as most (of several lengths the least), and that length."""
    good = rows.where(finite(vector))
    top = good.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return (good.where(F.size(vector) == top["size"]), top["size"]) if top else (good.limit(0), 0)


def matrix(column: pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


def two_sum(a, b):
    """a + b, and what rounding took from it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def merged(h, low, h2, low2):
    """The sum of two numbers of a high and a low part each."""
    s, e = two_sum(h, h2)
    t, f = two_sum(low, low2)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def column_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows, high and low parts, by halves."""
    h, low = x, np.zeros_like(x)
    while len(h) > 1:
        if len(h) % 2:
            h, low = (np.concatenate([m, np.zeros((1, m.shape[1]))]) for m in (h, low))
        h, low = merged(h[::2], low[::2], h[1::2], low[1::2])
    return (h[0], low[0]) if len(h) else (np.zeros(x.shape[1]),) * 2


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x less its mean, high and low parts."""
    h, e = two_sum(x, -mean[0])
    return two_sum(h, e - mean[1])


def products(h: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the outer products of a block's rows, high and low parts."""
    top = np.abs(h).max(axis=0, initial=0)
    unit = np.exp2(np.where(top > 0, np.frexp(top)[1], 0) - SLICE)
    cut = []
    for _ in range(SLICES):
        whole = np.rint(h / unit)
        h, low = two_sum(h - whole * unit, low)
        cut.append((whole, unit))
        unit = unit * 2.0**-SLICE
    acc = np.zeros((h.shape[1],) * 2), np.zeros((h.shape[1],) * 2)
    for a in reversed(range(SLICES)):
        for b in range(a, SLICES - a):
            part = (cut[a][0].T @ cut[b][0]) * np.outer(cut[a][1], cut[b][1])
            acc = merged(*acc, part, 0.0)
            acc = merged(*acc, part.T, 0.0) if a != b else acc
    return acc


def _merge(parts: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Parts (i, high, low) of all tasks, added row by row; a row of each i comes to the driver."""

    def add(batches):
        got: dict[int, tuple] = {}
        for b in batches:
            for i, h, low in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                new = h.values.to_numpy(), low.values.to_numpy()
                got[i] = merged(*got[i], *new) if i in got else new
        yield _parts(got)

    rows = parts.repartition(width(parts.sparkSession), "i").mapInArrow(add, "i int, high array<double>, low array<double>").collect()
    return {r["i"]: (np.array(r["high"]), np.array(r["low"])) for r in rows}


def _parts(got: dict[int, tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), *(pa.array([v[k].tolist() for v in got.values()], kind) for k in (0, 1))], ["i", "high", "low"])


def covariance(rows: DataFrame, dim: int, n: int, mean: tuple[np.ndarray, np.ndarray] | None = None, values=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean of the n vectors of rows (one column of arrays), and their covariance with divisor n, as high and low parts.

    ``mean`` (high, low) where it is known, else it is summed first; ``values``: a function from a matrix of vectors to the
    matrix whose covariance is wanted, of ``dim`` columns.  Memory is that of a block of rows and of dim^2 numbers.
    """

    def of(b) -> np.ndarray:
        x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
        return x if values is None else values(x)

    def sums(batches):
        acc = np.zeros(dim), np.zeros(dim)
        for b in batches:
            acc = merged(*acc, *column_sums(of(b))) if b.num_rows else acc
        yield _parts({0: acc})

    if mean is None:
        h, low = _merge(rows.mapInArrow(sums, "i int, high array<double>, low array<double>")).get(0, (np.zeros(dim),) * 2)
        exact = (h.astype(np.longdouble) + low) / max(n, 1)
        mean = exact.astype(np.float64), (exact - exact.astype(np.float64)).astype(np.float64)

    def outer(batches):
        acc, step = None, max(1, min(BLOCK, (1 << 22) // dim))
        for b in batches:
            x = of(b) if b.num_rows else np.zeros((0, dim))
            for k in range(0, len(x), step):
                new = products(*centred(x[k : k + step], mean))
                acc = merged(*acc, *new) if acc else new
        if acc:
            yield _parts({i: (acc[0][i], acc[1][i]) for i in range(dim)})

    got = _merge(rows.mapInArrow(outer, "i int, high array<double>, low array<double>"))
    high, low = (np.array([got[i][k] for i in range(dim)]) if got else np.zeros((dim, dim)) for k in (0, 1))
    return mean, high / max(n, 1), (low + _residue(high, n)) / max(n, 1)


def _residue(high: np.ndarray, n: int) -> np.ndarray:
    """What dividing ``high`` by n takes from it, in units of the dividend."""
    q = (high / max(n, 1)).astype(np.longdouble)
    return (high.astype(np.longdouble) - q * max(n, 1)).astype(np.float64)


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns, each with its largest entry above 0."""
    v = high.astype(np.longdouble) + low
    x = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)  # tridiagonal form, divide and conquer
    size = lambda m: np.sqrt((m * m).sum())
    for _ in range(2):
        r, s = np.eye(len(v)) - x.T @ x, x.T @ v @ x
        value = np.diag(s) / (1 - np.diag(r))
        gap = value[None, :] - value[:, None]
        near = np.abs(gap) <= 2 * (size(s - np.diag(value)) + size(v) * size(r))
        x = x + x @ np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1, gap))
    value = np.diag(x.T @ v @ x).astype(np.float64)
    x = (x / np.sqrt((x * x).sum(axis=0))).astype(np.float64)
    order = np.argsort(-value, kind="stable")
    x = x[:, order]
    return value[order], x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(x))] < 0, -1, 1)


def _total(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many vectors of longs there are, and their exact sums; halves of 32 bits, so that no sum overflows."""

    def run(batches):
        n, hi, lo = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            x = matrix(b.column(0), dim, np.int64)
            n, hi, lo = n + len(x), hi + (x >> 32).sum(axis=0), lo + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n] * dim), pa.array(range(dim), pa.int32()), pa.array(hi), pa.array(lo)], ["n", "i", "hi", "lo"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    rows = rows.mapInArrow(run, "n long, i int, hi long, lo long").groupBy("i").agg(F.sum("n").alias("n"), exact("hi"), exact("lo")).orderBy("i").collect()
    return (rows[0]["n"], [int(r["hi"]) * (1 << 32) + int(r["lo"]) for r in rows]) if rows else (0, [0] * dim)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum of (n x - S)^2 of each row; null where it is no long."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums))
    if most**2 * x.shape[1] <= LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v <= LONG else None for v in map(int, exact)]


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and leading component.

    A vector's entries become floor(scale c), past a long's range its ends.  Rows are left out whose vector is null, empty, holds null or non-finite
    entries, or is not as long as most are.  Mean, covariance and components are of the n distinct vectors, so that repeats
    weigh nothing; they are found by a hash aggregate, which meets copies before the shuffle.  ``deviation`` is the sum of
    (n x - S)^2 over the entries, null where that is no long; ``whitened`` is null for a component of no variance, and
    ``explained`` if there is no variance at all.  ``identity_error`` is the greatest entry of the whitened vectors' covariance, less the identity's, over components that vary.
    Null ids and repeated rows are whitened like any other; an empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    rows, dim = sized(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")), "v")
    ints = rows.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dim:
        return spark.createDataFrame([], schema)
    fit = written(ints.select("x").distinct())
    n, sums = _total(fit, dim)
    whole = [s // n for s in sums]
    rest = np.array([s - w * n for s, w in zip(sums, whole)], np.float64).astype(np.longdouble) / n
    exact = np.array(whole, np.float64).astype(np.longdouble) + rest
    mean = exact.astype(np.float64), (exact - exact.astype(np.float64)).astype(np.float64)
    _, high, low = covariance(fit, dim, n, mean)
    value, axes = eigen(high, low)
    most = min(components, dim)
    varied = value[:most] > value[0] * dim * np.finfo(float).eps
    scaled = axes[:, :most] / np.sqrt(np.where(varied, value[:most], 1.0))
    project = lambda x: sum(part @ scaled for part in centred(x, mean))
    trace = float(np.trace(high))
    explained = [float(v) / trace if trace > 0 else None for v in value[:most]]
    _, cov, _ = covariance(fit, most, n, values=project)
    error = float(np.abs(cov - np.eye(most))[np.ix_(varied, varied)].max(initial=0))

    def run(batches):
        for b in batches:
            x = matrix(b.column(1), dim, np.int64)
            made = np.where(varied, project(x.astype(np.float64)), np.nan)
            each = np.repeat(np.arange(len(x)), most)
            flat = made.reshape(-1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, most + 1), len(x)), pa.int32()), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(flat, pa.float64(), mask=np.isnan(flat))], ["vec_id", "component", "deviation", "whitened"])

    out = ints.mapInArrow(run, "vec_id long, component int, deviation long, whitened double")
    share = F.get(F.array(*[F.lit(e).cast("double") for e in explained]), F.col("component") - 1)
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
