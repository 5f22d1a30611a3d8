"""Operator 12 against numpy's own decomposition."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from qtrail.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, component string"


def _table(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [None if c is None else float(c) for c in v], 0, "n", "c") for i, v in enumerate(vectors)], SCHEMA)


def _plain(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    centred = (len(u) * u - u.sum(axis=0)) / len(u)
    values, components = np.linalg.eigh(centred.T @ centred / len(u))
    return x, u, values[::-1], components[:, ::-1]


def _check(spark, vectors):
    got = whitening.whiten(_table(spark, vectors)).toPandas()
    x, u, values, components = _plain(vectors)
    k = min(16, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == len(vectors) * k and set(got.n) == {len(u)}
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    plain = ((len(u) * x - u.sum(axis=0)) / len(u)) @ components[:, :k] / np.sqrt(values[:k])
    sign = np.sign((w * plain).sum(axis=0))
    assert np.abs(w - plain * sign).max() < 1e-6
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, values[:k] / values.sum(), rtol=1e-9)
    deviation = ((len(u) * x - u.sum(axis=0)) ** 2).sum(axis=1)
    assert (got.drop_duplicates("vec_id").sort_values("vec_id").deviation.to_numpy() == deviation).all()
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    first = u if len(u) < len(x) else x  # the covariance of the fit list's whitened rows is the identity
    assert len(first) == len(u)
    return got


def test_against_plain_decomposition(spark):
    rng = np.random.default_rng(3)
    _check(spark, rng.normal(size=(300, 24)) * np.linspace(0.1, 3, 24))


def test_copies_count_once(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 5))
    _check(spark, np.concatenate([base, np.tile(base[0], (80, 1)), base[:10]]))


def test_rank_below_sixteen_and_dependent_dimensions(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-20, 20, size=(100, 3)) / 8
    _check(spark, np.column_stack([a, a[:, :1], 2 * a[:, 1:2], np.full((100, 1), 7.0)]))


def test_wide_range_of_variances(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(400, 6)) * np.array([1e5, 1e3, 10, 1, 0.5, 0.1])  # beyond numpy's decomposition of the scatter
    got = whitening.whiten(_table(spark, vectors)).toPandas()
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.shape == (400, 6) and got.identity_error.max() < 1e-9 and got.explained.min() < 1e-10
    assert np.abs(np.cov(w.T, bias=True) - np.eye(6)).max() < 1e-9


def test_defined_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(7)
    base = [list(v) for v in rng.normal(size=(20, 3))]
    table = _table(spark, [*base, None, [1.0, None, 2.0], [nan, 1, 2], [inf, 1, 2], [], [1.0, 2.0], [1.0, 5.0]])
    table = table.unionByName(table.limit(1).withColumn("vec_id", F.lit(None).cast("bigint"))).unionByName(table.limit(1))
    got = whitening.whiten(table).toPandas()
    assert set(got.vec_id.dropna()) == {*range(20), 25, 26} and got.vec_id.isna().sum() == 3
    assert (got.vec_id == 0).sum() == 6  # the row that repeats has its rows twice
    assert set(got[got.vec_id < 20].n) == {20} and set(got[got.vec_id > 20].n) == {2}
    assert (got.vec_id > 20).sum() == 2  # two vectors: one component


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(_table(spark, vectors)).count() == 0


def test_huge_entries_stay_exact(spark):
    got = whitening.whiten(_table(spark, [[1e30, 1.0], [-1e30, 2.0], [0.0, 4.0]])).toPandas()
    x = np.array([[1 << 40, 64], [-(1 << 40), 128], [0, 256]], object)
    s = x.sum(axis=0)
    want = [min(int(((3 * r - s) ** 2).sum()), (1 << 63) - 1) for r in x]
    assert got.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == want
    assert got.identity_error.max() < 1e-4


def test_factor_and_rotation():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(9, 6))
    scatter = a @ a.T  # rank 6 of 9
    factor = whitening.pivoted_cholesky(scatter)
    assert factor.shape == (9, 6) and np.allclose(factor @ factor.T, scatter)
    order = np.argsort([np.flatnonzero(row)[-1] for row in factor], kind="stable")
    assert np.allclose(np.triu(factor[order][:6], 1), 0)  # triangular in the order of the pivots
    g = whitening.orthogonal_columns(factor)
    off = g.T @ g
    assert np.abs(off - np.diag(off.diagonal())).max() < 1e-10
    assert np.allclose(np.sort(off.diagonal()), np.sort(np.linalg.eigvalsh(scatter))[3:])
