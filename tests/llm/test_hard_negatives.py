"""Operator 13 against a search over all pairs."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qtrail.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, x string"


def _table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], l, "r", "x") for i, v, l in rows], SCHEMA)


def _plain(rows, every=10):
    last = (1 << 63) - 1
    rows = [(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v), l) for i, v, l in rows]
    rows, out = sorted(set(rows), key=str), []
    for a, (i, v, l) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), last if j is None else j, k) for k, (j, w, m) in enumerate(rows) if len(w) == len(v) and k != a)
        for ps, _, p in [s for s in scored if rows[s[2]][2] == l][:5]:
            inside = [(ns, n) for ns, _, n in scored if rows[n][2] != l and 50 * -ps <= 100 * -ns <= 95 * -ps][:3]
            out += [(i, rows[p][0], r + 1, rows[n][0], -ps, -ns) for r, (ns, n) in enumerate(inside)]
    return sorted(out, key=str)


def _got(table, every=10):
    return sorted((tuple(r) for r in H.mine(table, F.col("vec_id") % every == 0).collect()), key=str)


@pytest.mark.parametrize("dim,scale", [(64, 1.0), (5, 1.0), (100, 30.0)])
def test_against_all_pairs(spark, monkeypatch, dim, scale):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(6, dim))
    rows = [(i, scale * (0.7 * centres[rng.integers(6)] + rng.normal(size=dim)), int(rng.integers(4))) for i in range(400)]
    monkeypatch.setattr(H, "ROWS", 90)  # several blocks on either side
    monkeypatch.setattr(H, "ANCHORS", 15)
    assert _got(_table(spark, rows)) == _plain(rows)


def test_ties_and_one_vector_of_a_third(spark):
    rng = np.random.default_rng(1)
    grid = rng.integers(-2, 3, size=(150, 4)) / 4  # many equal scores
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(grid)]
    rows += [(200 + i, [0.5, 0.5, 0.25, 0.0], i % 3) for i in range(80)]
    got = _got(_table(spark, rows))
    assert got == _plain(rows) and got


def test_defined_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=6), i % 2) for i in range(40)]
    good += [(None, rng.normal(size=6), 1), good[10], good[11], (10, rng.normal(size=6), 0), (50, [1.0, 2.0], 0), (51, [2.0, 2.0], 0), (52, [1.5, 1.0], 1)]
    bad = [(60, None, 0), (70, [1.0, None] * 3, 0), (80, [nan] * 6, 0), (90, [inf] * 6, 0), (100, rng.normal(size=6), None), (110, [], 0)]
    assert _got(_table(spark, good + bad)) == _plain(good)


def test_nothing_to_mine(spark):
    assert _got(_table(spark, [])) == []
    assert _got(_table(spark, [(0, [1.0], 1)])) == []
    assert _got(_table(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []


def test_negative_and_huge_scores(spark):
    rows = [(0, [1e30, 0.0], 0), (1, [1e30, 1.0], 0), (2, [3e14, 0.0], 1), (3, [-5.0, 1.0], 1), (4, [-1e30, 0.0], 0)]
    got = _got(_table(spark, rows))
    assert all(r[4] > 0 for r in got)  # a positive below zero has an empty window
    assert H.window(-7) == (-3, -7) and H.window(100) == (50, 95) and H.window(101) == (51, 95) and H.window(0) == (0, 0)


def test_intervals_hold_the_score_and_filter():
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(size=(3000, 64)) / 8).astype(np.int64)
    codes, along, left = H.encode(x.astype(float))
    block = H.Block(pd.DataFrame({"x": [r.tobytes() for r in x], "codes": [c.tobytes() for c in codes],
                                  "parts": [np.stack([a, b]).tobytes() for a, b in zip(along, left)], "label": 0, "rid": range(3000), "vec_id": range(3000)}), 64)
    rows, seen = np.arange(3000), []

    def keep(low, high):
        score = H.exact_scores(x[0], x)
        assert ((low <= score) & (score <= high)).all()
        seen.append((high - low).mean())
        return np.ones(len(low), bool)
    block.narrowed(H.Queries(x[:1]), 0, rows, keep)
    assert all(b < 0.75 * a for a, b in zip(seen, seen[1:]))  # every level narrows
    block.scored = 0
    H.positives(block, H.Queries(x[:1]), 0, 0, (0, 0), 5)
    assert block.scored < 0.1 * 3000  # scored exactly


def test_exact_scores_beyond_doubles():
    q, x = np.array([1 << 50, 3]), np.array([[1 << 50, 1], [5, 7], [-(1 << 50), 0]])
    assert H.exact_scores(q, x).tolist() == [(1 << 63) - 1, 5 * (1 << 50) + 21, -((1 << 63) - 1)]
