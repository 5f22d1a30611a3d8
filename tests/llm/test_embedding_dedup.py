import math
import random

import numpy as np
import pandas as pd

from qtrail.llm import embedding_dedup as E

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep string, n string, links string"


def run(spark, vectors):
    """{vec_id: rows} of the result for (vec_id, vector) pairs."""
    df = spark.createDataFrame([(i, v, 0, "r", "n", "l") for i, v in vectors], SCHEMA)
    return sorted((tuple(r) for r in E.near_duplicates(df).collect()), key=str)


def brute(vectors):
    """The contract by plain loops."""
    good = [(i, np.array(v, float)) for i, v in vectors if usable(v)]
    name = [i if i is not None else ("no id", k) for k, (i, v) in enumerate((i, v) for i, v in vectors if usable(v))]
    root = {i: i for i in [*name, *(i for i, _ in vectors)]}
    order = lambda i: (isinstance(i, tuple), i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    out = []
    linked = {}
    for a, (i, x) in enumerate(good):
        linked[a] = [b for b, (_, y) in enumerate(good) if b != a and len(x) == len(y)
                     and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9]
        for b in linked[a]:
            p, q = find(name[a]), find(name[b])
            root[max(p, q, key=order)] = min(p, q, key=order)
    counts = iter(range(len(good)))
    for i, v in vectors:
        place = next(counts) if usable(v) else None
        top = i if place is None else find(name[place])
        top = None if isinstance(top, tuple) else top
        out.append((i, 0 if place is None else len(linked[place]), top, top is None or top == i))
    return sorted(out, key=str)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "block_of", lambda dim: 5)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 8))
    vectors = [(int(i), [float(np.float32(x)) for x in centres[rng.integers(25)] + rng.normal(scale=0.35, size=8)])
               for i in rng.permutation(150)]
    vectors += [(1000 + k, vectors[0][1]) for k in range(9)]  # a hot vector
    vectors += [(2000, [2 * x for x in vectors[0][1]]), (2001, [0.0] * 8), (2002, None), (2003, [float("nan")] * 8),
                (2004, [1.0, None] + [0.0] * 6), (2005, []), (2006, [1.0, 2.0]), (2007, [1.0, 2.1]), (2008, [float("inf")] * 8),
                (None, vectors[0][1]), (None, None), (None, [0.0, 3.0]), (None, [0.1, 3.0]), (5000, vectors[3][1]), (5000, vectors[3][1])]
    assert run(spark, vectors) == brute(vectors)


def test_empty_and_threshold(spark):
    assert run(spark, []) == []
    angle = math.acos(0.9)
    got = run(spark, [(1, [1.0, 0.0]), (2, [math.cos(angle - 1e-3), math.sin(angle - 1e-3)]),
                      (3, [math.cos(-angle - 1e-3), math.sin(-angle - 1e-3)])])
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_cells_cover_every_link():
    rng = random.Random(1)
    units = E.unit(np.array([[rng.gauss(0, 1) for _ in range(4)] for _ in range(400)]))
    space = E.Cells(E.farthest_first(units, 12))
    home, distance, inside = space.place(units)
    space.radius = np.array([distance[home == j].max(initial=0) for j in range(12)])
    _, _, inside = space.place(units)
    close = units @ units.T >= 0.9
    for i, j in zip(*np.nonzero(close)):
        assert inside[j, home[i]]
    assert not inside.all()


def test_block_without_members():
    empty = pd.DataFrame({"a": [0], "b": [1], "first": [True], "rep": [1], "n": [1], "vector": [np.ones(2).tobytes()]})
    assert len(E.join_blocks(empty)) == 0


def test_every_pair_meets_in_one_task():
    """Blocks of homes and guests: each pair within the bound is compared once, whatever the block counts."""
    rng = np.random.default_rng(5)
    units = E.unit(rng.normal(size=(300, 3)))
    space = E.Cells(E.farthest_first(units, 6))
    space.home_blocks, space.guest_blocks = np.array([1, 2, 3, 1, 4, 2]), np.array([3, 1, 2, 2, 1, 1])
    home, _, inside = space.place(units)
    lot = rng.integers(0, 1 << 40, 300)
    met = np.zeros((300, 300), int)
    for j in range(6):
        tasks = {}
        for at, a, b, first in E._tasks(space, j, home, inside, lot, 50):
            for i, x, y, f in zip(at, a, b, first):
                tasks.setdefault((x, y), ([], []))[0 if f else 1].append(i)
        for (x, y), (one, two) in tasks.items():
            met[np.ix_(one, one if x == y else two)] += 1
            if x != y:
                met[np.ix_(two, one)] += 1
    close = (units @ units.T >= 0.9) & ~np.eye(300, dtype=bool)
    assert (met[close] == 1).all() and met[~np.eye(300, dtype=bool)].max() == 1


def test_replicas_where_bounds_exclude_nothing():
    """Random directions of 64 dimensions in four cells of one block: at most four replicas each, not eight."""
    units = E.unit(np.random.default_rng(7).normal(size=(400, 64)))
    space = E.Cells(E.farthest_first(units, 4))
    home, _, inside = space.place(units)
    space.guest_blocks = np.ones(4, np.int64)
    sent = sum(len(at) for j in range(4) for at, *_ in E._tasks(space, j, home, inside, np.arange(400), 4096))
    assert sent <= 4 * 400


def test_centres_of_groups_leave_fewer_cells():
    rng = np.random.default_rng(9)
    middles = E.unit(rng.normal(size=(6, 32)))
    units = E.unit(middles[rng.integers(6, size=600)] + rng.normal(scale=0.06, size=(600, 32)))
    pivots = E.farthest_first(units, 6)
    moved = E.group_centres(units, pivots)
    assert np.allclose(np.linalg.norm(moved, axis=1), 1)
    assert E.cells_per_vector(units, moved) <= E.cells_per_vector(units, pivots)
