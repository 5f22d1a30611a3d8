"""Operator 12: embedding whitening by pivoted Cholesky and one-sided Jacobi.

Every entry c becomes the integer x = floor(scale * c) + shift.  The fit list is each
distinct x vector once; components are the eigenvectors of its covariance.

1. distinct vectors are found by one shuffle of the vectors, map side first, so a vector
   that a third of all rows share is one row per task;
2. two passes over them give the exact sums and, about the nearest integer to every
   mean, the exact scatter: integer products, added as decimals, so the result depends
   on no order of addition.  What the integer centre leaves is taken off exactly;
3. the driver factors the dimensions x dimensions scatter (its size is bounded by the
   vector length): Cholesky with the largest remaining pivot gives a triangular factor
   and the rank, one-sided Jacobi rotates the columns of that factor until they are
   orthogonal.  Their squared norms are the eigenvalues, the normalised columns the
   components, the largest entry of a component is positive;
4. a pass over the distinct vectors measures the covariance of the whitened ones, a
   pass over all rows writes the result.

Vectors travel in the one shuffle only; tasks hold a batch and a matrix.

Defined results: rows with a null id are rows like others; repeated rows give their
rows each; vectors of unequal length belong to fits of their own (one for each
length), empty vectors have no component; components without variance (a rank below
16, one distinct vector) have no rows, as nothing whitens them; x is held within
+-2**40 and a deviation beyond a long counts as the largest long; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_stored, stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
MOST = 1 << 40
_EXACT = 1 << 53  # integers that doubles hold


class Basis:
    """Fit of one vector length: number of distinct vectors, sums, directions over sqrt(eigenvalue)."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, components: np.ndarray, trace: float):
        self.n, self.sums = n, np.array(sums, np.int64) if max(map(abs, sums), default=0) < 1 << 62 else np.array(sums, object)
        self.explained = (values / trace).astype(np.float64) if len(values) else np.empty(0)
        self.directions = (components / np.sqrt(values)).astype(np.float64)
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        if self.sums.dtype == object or self.n * max(int(np.abs(x).max(initial=0)), 1) >= 1 << 62:
            return x.astype(object) * self.n - self.sums
        return x * self.n - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(np.float64) @ self.directions

    def deviation(self, x: np.ndarray) -> np.ndarray:
        y = self.centred(x)
        if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * max(y.shape[1], 1) < 1 << 63:
            return (y * y).sum(axis=1)
        y = y.astype(object)
        return np.array([min(int(v), (1 << 63) - 1) for v in (y * y).sum(axis=1)], np.int64)


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """Columns l with scatter = l l^T, taken at the largest remaining diagonal: triangular in
    the order of the pivots.  It ends where the rest is rounding."""
    size = len(scatter)
    rest, done, factor = scatter.diagonal().copy(), np.zeros(size, bool), np.zeros((size, 0), scatter.dtype)
    least = size * np.finfo(scatter.dtype).eps * max(rest.max(initial=0), 0)
    while not done.all():
        pivot = int(np.where(done, -1, rest).argmax())
        if rest[pivot] <= least:
            break
        column = (scatter[:, pivot] - factor @ factor[pivot]) / np.sqrt(rest[pivot])
        column[done] = 0
        rest -= column * column
        done[pivot] = True
        factor = np.column_stack([factor, column])
    return factor


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """One-sided Jacobi: the columns rotated in pairs until all are orthogonal."""
    g = np.asfortranarray(factor.copy())
    count, close = g.shape[1], 16 * np.finfo(g.dtype).eps
    for _ in range(60):
        turned = False
        for p in range(count - 1):
            for q in range(p + 1, count):
                a, b = g[:, p], g[:, q]
                aa, bb, ab = a @ a, b @ b, a @ b
                if abs(ab) <= close * np.sqrt(aa * bb):
                    continue
                turned = True
                z = (bb - aa) / (2 * ab)
                t = (1 if z >= 0 else -1) / (abs(z) + np.sqrt(1 + z * z))
                cos = 1 / np.sqrt(1 + t * t)
                g[:, p], g[:, q] = cos * a - cos * t * b, cos * t * a + cos * b
        if not turned:
            break
    return g


def principal(scatter: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns), largest first, at most ``most``."""
    g = orthogonal_columns(pivoted_cholesky(scatter))
    values = (g * g).sum(axis=0)
    order = np.argsort(-values, kind="stable")[:most]
    values, components = values[order], g[:, order] / np.sqrt(values[order])
    at = np.abs(components).argmax(axis=0) if components.size else np.empty(0, int)
    return values, components * np.sign(components[at, np.arange(len(order))])


def _matrices(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of a batch by length: (places in the batch, matrix)."""
    ends = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    return {int(s): (at := np.flatnonzero(sizes == s), flat[ends[at][:, None] + np.arange(s)]) for s in np.unique(sizes)}


def _exact_sum(rows: dict, schema: pa.Schema):
    values = [(*k, Decimal(v)) for k, v in rows.items()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*values), schema)], schema=schema) if values else None


_WIDE = pa.decimal128(38, 0)


def _sums(batches):
    """Per task (dim, i, total): sums of entry i; at i = -1 the number of vectors."""
    total: dict[tuple, int] = {}
    for batch in batches:
        for dim, (at, x) in _matrices(batch.column("x")).items():
            for i, v in enumerate([len(at), *x.sum(axis=0).tolist()]):
                total[dim, i - 1] = total.get((dim, i - 1), 0) + int(v)
    if out := _exact_sum(total, pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("total", _WIDE)])):
        yield out


def _products(batches, centres):
    """Per task (dim, i, j, total): exact sums of products of entries i <= j about the centres."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, (_, x) in _matrices(batch.column("x")).items():
            z = x - np.array(centres.value[dim], np.int64)
            if int(np.abs(z).max(initial=0)) ** 2 * len(z) < _EXACT:  # every sum is an integer that a double holds
                z = z.astype(np.float64)
                made = (z.T @ z).astype(np.int64).astype(object)
            else:
                made = z.astype(object).T @ z.astype(object)
            total[dim] = total[dim] + made if dim in total else made
    rows = {(dim, i, j): int(m[i, j]) for dim, m in total.items() for i in range(dim) for j in range(i, dim)}
    if out := _exact_sum(rows, pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", _WIDE)])):
        yield out


def _second_moments(batches, bases):
    """Per task (dim, i, j, total): sums of products of whitened entries; at j = -1 of the entries."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, (at, x) in _matrices(batch.column("x")).items():
            w = bases.value[dim].whitened(x)
            w = np.column_stack([np.ones(len(w)), w])
            total[dim] = total.get(dim, 0.0) + w.T @ w
    for dim, m in total.items():
        i, j = np.indices(m.shape).reshape(2, -1) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m.ravel())],
                                         names=["dim", "i", "j", "total"])


_RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _result(batches, bases):
    for batch in batches:
        ids = batch.column("vec_id")
        for dim, (at, x) in _matrices(batch.column("x")).items():
            basis = bases.value[dim]
            k, rows = len(basis.explained), len(at)
            if not k:
                continue
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, basis.n, np.int64)), pa.array(np.repeat(basis.deviation(x), k)),
                 pa.array(basis.whitened(x).ravel()), pa.array(np.tile(basis.explained, rows)), pa.array(np.full(rows * k, basis.identity_error))],
                names=[c.split()[0] for c in _RESULT.split(", ")])


def fit(points: DataFrame, components: int = COMPONENTS) -> dict[int, Basis]:
    """Basis of every vector length in ``points`` (x: distinct vectors); what reaches the driver is one
    row for each pair of dimensions."""
    spark = points.sparkSession
    sums: dict[int, dict[int, int]] = {}
    for r in points.mapInArrow(_sums, "dim int, i int, total decimal(38,0)").groupBy("dim", "i").agg(F.sum("total").alias("total")).collect():
        sums.setdefault(r.dim, {})[r.i] = int(r.total)
    sizes = {dim: s[-1] for dim, s in sums.items()}
    sums = {dim: [s[i] for i in range(dim)] for dim, s in sums.items()}
    centres = {dim: [(2 * v + sizes[dim]) // (2 * sizes[dim]) for v in s] for dim, s in sums.items()}
    shared = spark.sparkContext.broadcast(centres)
    found = points.mapInArrow(lambda b: _products(b, shared), "dim int, i int, j int, total decimal(38,0)")
    raw = {dim: np.zeros((dim, dim), object) for dim in sums}
    for r in found.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect():
        raw[r.dim][r.i, r.j] = raw[r.dim][r.j, r.i] = int(r.total)
    out = {}
    for dim, n in sizes.items():
        left = np.array([s - n * c for s, c in zip(sums[dim], centres[dim])], object)  # sums about the centres
        exact = n * raw[dim] - np.outer(left, left) if dim else raw[dim]                # n * n * covariance, in integers
        wide = np.array([[np.longdouble(str(v)) for v in row] for row in exact], np.longdouble).reshape(dim, dim) / np.longdouble(n) ** 2
        values, vectors = principal(wide, components)
        out[dim] = Basis(n, sums[dim], values, vectors, wide.trace())
    return out


def measure(points: DataFrame, bases: dict[int, Basis]) -> None:
    """Sets ``identity_error`` of every basis from the whitened vectors themselves."""
    shared = points.sparkSession.sparkContext.broadcast(bases)
    moments = {dim: np.zeros((len(b.explained) + 1,) * 2) for dim, b in bases.items()}
    found = points.mapInArrow(lambda b: _second_moments(b, shared), "dim int, i int, j int, total double")
    for r in found.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect():
        moments[r.dim][r.i + 1, r.j + 1] = r.total
    for dim, m in moments.items():
        mean = m[0, 1:] / bases[dim].n
        off = m[1:, 1:] / bases[dim].n - np.outer(mean, mean) - np.eye(len(mean))
        bases[dim].identity_error = float(np.abs(off).max(initial=0.0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT,
           components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each usable row
    and component.  Runs jobs while it is built."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    held = lambda c: F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(float(-MOST)))
    rows = vectors.filter(usable).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(v, lambda c: F.floor(held(c)) + shift).alias("x"))
    points, scratch = stored(rows.select("x").distinct(), "distinct-vectors")
    bases = fit(points, components)
    measure(points, bases)
    drop_stored(vectors.sparkSession, scratch)
    shared = vectors.sparkSession.sparkContext.broadcast(bases)
    return rows.mapInArrow(lambda b: _result(b, shared), _RESULT)
