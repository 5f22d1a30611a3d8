"""Operator 1: exact metric range join of embeddings.

Vectors link when their cosine (double precision) is at least 0.9, that is when
their unit vectors lie within EPS = sqrt(2 - 2 * 0.9) of each other.

1. vectors equal in every component fold to one *class* with a count, so a vector
   that a third of all rows share costs one row;
2. pivots (farthest-first over a bounded sample of the classes, moved to the centres of their groups if that
   leaves fewer cells a vector) part the space: a vector's home is the cell of its nearest pivot.  By the triangle
   inequality a vector within EPS of x has its home in cell j only if
   (d(x, p_j)^2 - d(x, p_k)^2) / (2 d(p_j, p_k)) <= EPS for every other pivot k and
   d(x, p_j) <= radius of the cell + EPS; x is a guest of the cells before its home that pass.
   Pivots only steer the work: whatever they are, no link is lost;
3. cells join independently, homes with homes and with guests, so two classes meet in one place, the earlier of
   their cells.  Homes and guests are dealt by hash over blocks of at most ``BLOCK_BYTES`` and ``BLOCK`` vectors;
   one task compares two blocks, so no task holds a whole cell however dense it is.  Where the bounds exclude
   nothing this is the upper half of a grid of blocks: of n classes each is sent n / block times.
   Single precision sorts out clear cases, all near the threshold are computed in double;
4. a task gives the links that it found for both sides, so counts add up over tasks, and a spanning forest of
   its links, whose components over all tasks are the result.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (n_links 0, a component of their own); vectors of
unequal length do not link; repeated rows are vectors of their own, and rows with
one id are in one component; rows with a null id are neighbours like all others and get their links and the
smallest id reachable, and are kept only if none is; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ._common import U64, mix, sample_by_hash, stored

COSINE = 0.9
EPS = float(np.sqrt(2 - 2 * COSINE))
SLACK = 1e-9  # for rounding of distances
BLOCK, BLOCK_BYTES = 16384, 1 << 23
SAMPLE, MOST_PIVOTS = 4096, 1024
UNSURE = 5e-5  # single-precision cosines this near the threshold are computed again
_ROWS = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def farthest_first(vectors: np.ndarray, n: int) -> np.ndarray:
    """``n`` pivots, each the sample vector farthest from those before it."""
    chosen, nearest = [0], np.full(len(vectors), np.inf)
    while len(chosen) < n:
        nearest = np.minimum(nearest, 2 - 2 * (vectors @ vectors[chosen[-1]]))
        if nearest.max() <= 1e-12:
            break
        chosen.append(int(nearest.argmax()))
    return vectors[chosen]


def group_centres(vectors: np.ndarray, pivots: np.ndarray, rounds: int = 4) -> np.ndarray:
    """The pivots moved to the mean directions of the sample vectors nearest to them."""
    for _ in range(rounds):
        sums = np.zeros_like(pivots)
        np.add.at(sums, (vectors @ pivots.T).argmax(axis=1), vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), pivots)
    return pivots / np.linalg.norm(pivots, axis=1, keepdims=True)


def cells_per_vector(vectors: np.ndarray, pivots: np.ndarray) -> float:
    space = Cells(pivots)
    home, distance, _ = space.place(vectors)
    space.radius = np.array([distance[home == j].max(initial=0) for j in range(len(pivots))])
    return float(space.place(vectors)[2].sum(axis=1).mean())


def block_of(dim: int) -> int:
    """Vectors of this length in a block."""
    return min(BLOCK, max(256, BLOCK_BYTES // (8 * dim)))


class Cells:
    """Pivots of one vector length, and later the radius and blocks of their cells."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0.0))
        self.apart = np.where(apart > 0, 2 * apart, np.inf)
        self.radius = np.full(len(pivots), 2.0)
        self.home_blocks, self.guest_blocks = np.ones(len(pivots), np.int64), np.zeros(len(pivots), np.int64)

    def place(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home of each vector, its distance to it, cells it must be in) - rows by cells."""
        squared = np.maximum(2 - 2 * units @ self.pivots.T, 0.0)
        home = squared.argmin(axis=1)
        inside = np.sqrt(squared) <= self.radius[None, :] + EPS + SLACK
        for k in range(len(self.pivots)):  # the half space towards pivot j, seen from pivot k
            inside &= (squared - squared[:, k:k + 1]) / self.apart[k][None, :] <= EPS + SLACK
        at = np.arange(len(units))
        inside[at, home] = True
        return home, np.sqrt(squared[at, home]), inside


def _vectors(batch, column: str = "vector") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by vector length: (places in the batch, unit vectors)."""
    raw = batch.column(column).to_pylist()
    sizes = np.array([len(v) for v in raw], np.int64)
    out = {}
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out[int(size) // 8] = rows, np.frombuffer(b"".join(raw[i] for i in rows), "<f8").reshape(len(rows), -1)
    return out


def _units(batches):
    for batch in batches:
        found = batch.column("embedding").to_pylist()
        vectors = [unit(np.array([v], np.float64))[0].tobytes() for v in found]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array(vectors, pa.binary())],
                                         names=["rep", "n", "vector"])


def _sizes(batches, cells):
    """Homes, guests and radius of each cell, per batch."""
    for batch in batches:
        rows = []
        for dim, (_, units) in _vectors(batch).items():
            home, distance, inside = cells.value[dim].place(units)
            for j in range(inside.shape[1]):
                own = distance[home == j]
                rows.append((dim, j, len(own), int((inside[:, j] & (home > j)).sum()), float(own.max(initial=0))))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=["dim", "cell", "homes", "guests", "radius"])


_DEALT = "dim int, cell int, a int, b int, first boolean, rep bigint, n bigint, vector binary"


def _tasks(space: Cells, j: int, home: np.ndarray, inside: np.ndarray, lot: np.ndarray, most: int):
    """(vectors, a, b, does it stand on the side of block a) of cell j: blocks of homes come first, then those
    of guests; block a of homes meets every block b from itself on.  About ``most`` rows at a time."""
    homes, guests = int(space.home_blocks[j]), int(space.guest_blocks[j])
    every = np.arange(homes + guests)
    own, visiting = np.flatnonzero(home == j), np.flatnonzero(inside[:, j] & (home > j))
    step = max(1, most // len(every))
    for lo in range(0, len(own), step):
        at = np.repeat(own[lo:lo + step], len(every))
        block, other = lot[at] % homes, np.tile(every, len(at) // len(every))
        yield at, np.minimum(block, other), np.maximum(block, other), block <= other
    step = max(1, most // homes)
    for lo in range(0, len(visiting), step):
        at = np.repeat(visiting[lo:lo + step], homes)
        yield at, np.tile(every[:homes], len(at) // homes), homes + lot[at] // homes % guests, np.zeros(len(at), bool)


def _dealt(batches, cells):
    """One row for each task (block a against block b of a cell) that a vector takes part in."""
    for batch in batches:
        reps, n = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
        for dim, (rows, units) in _vectors(batch).items():
            space = cells.value[dim]
            home, _, inside = space.place(units)
            lot = (mix(reps[rows].view(U64)) >> U64(1)).astype(np.int64)
            for j in np.flatnonzero(inside.any(axis=0)):
                for at, a, b, first in _tasks(space, j, home, inside, lot, max(1, BLOCK_BYTES // (8 * dim))):
                    size = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, dim, np.int32)), pa.array(np.full(size, j, np.int32)),
                         pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(first), pa.array(reps[rows[at]]),
                         pa.array(n[rows[at]]), pa.array([units[i].tobytes() for i in at], pa.binary())],
                        names=[c.split()[0] for c in _DEALT.split(", ")])


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = parent[at]
    while True:
        above = parent[found]
        if (above == found).all():
            return found
        found = above


def join_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """rep, links (weight of the classes that it links to here), root (in a spanning forest of the links
    found here, by smallest rep) of the linked classes of two blocks, or of one block with itself."""
    group = group.sort_values("rep", kind="stable")
    reps, weight, first = group["rep"].to_numpy(), group["n"].to_numpy(), group["first"].to_numpy(bool)
    itself = bool((group["a"] == group["b"]).all())
    left = np.flatnonzero(first)
    right = left if itself else np.flatnonzero(~first)
    if not len(left) or not len(right):
        return pd.DataFrame({"rep": [], "links": [], "root": []}).astype(np.int64)
    units = np.frombuffer(b"".join(group["vector"]), "<f8").reshape(len(group), -1)
    singles = units.astype(np.float32)
    others = singles[right].T
    parent, links = np.arange(len(group)), np.zeros(len(group), np.int64)
    for lo in range(0, len(left), _ROWS):
        some = left[lo:lo + _ROWS]
        close = singles[some] @ others
        row, column = np.nonzero(close >= COSINE - UNSURE)
        unsure = np.flatnonzero(close[row, column] < COSINE + UNSURE)
        sure = np.ones(len(row), bool)
        sure[unsure] = np.einsum("ij,ij->i", units[some[row[unsure]]], units[right[column[unsure]]]) >= COSINE
        x, y = some[row], right[column]
        sure &= x != y
        x, y = x[sure], y[sure]
        np.add.at(links, x, weight[y])
        if not itself:
            np.add.at(links, y, weight[x])
        for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1):
            if len(part):
                linked = np.append(y[part], x[part[0]])
                roots = np.unique(_roots(parent, linked))
                parent[roots] = parent[linked] = roots[0]
    used = np.flatnonzero(links > 0)
    return pd.DataFrame({"rep": reps[used], "links": links[used], "root": reps[_roots(parent, used)]})


def _cells(classes: DataFrame) -> dict[int, Cells]:
    """Pivots per vector length from a bounded sample."""
    spark = classes.sparkSession
    out = {}
    counts = classes.groupBy((F.length("vector") / 8).cast("int").alias("dim")).count().collect()  # one row per length
    for dim, n in counts:
        sample = sample_by_hash(classes.filter(F.length("vector") == 8 * dim).select("rep", "vector"), "rep", SAMPLE, 8).collect()
        found = np.frombuffer(b"".join(r.vector for r in sample), "<f8").reshape(len(sample), dim)
        pivots = farthest_first(found, min(MOST_PIVOTS, -(-n // block_of(dim))))
        out[dim] = Cells(min((pivots, group_centres(found, pivots)), key=lambda p: cells_per_vector(found[:512], p)))
    if out:
        shared = spark.sparkContext.broadcast(out)
        sized = (classes.mapInArrow(lambda b: _sizes(b, shared), "dim int, cell int, homes bigint, guests bigint, radius double")
                 .groupBy("dim", "cell").agg(F.sum("homes").alias("homes"), F.sum("guests").alias("guests"),
                                             F.max("radius").alias("radius")).collect())  # one row per pivot
        for r in sized:
            space, block = out[r.dim], block_of(r.dim)
            space.radius[r.cell] = r.radius
            space.home_blocks[r.cell] = max(1, -(-r.homes // block))
            space.guest_blocks[r.cell] = -(-r.guests // block)
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Runs jobs while it is built."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) \
        & F.exists(v, lambda x: x != 0.0)
    usable = F.coalesce(usable, F.lit(False))
    keys = {"k1": F.when(usable, F.xxhash64(v)), "k2": F.when(usable, F.xxhash64(F.lit(5), v))}
    src = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("embedding"), *[k.alias(n) for n, k in keys.items()])
    folded = (src.filter("k1 is not null").groupBy("k1", "k2")
              .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")))
    # a class is a node of its own, whatever the ids of its rows
    folded, _ = stored(folded.withColumn("node", F.xxhash64("k1", "k2")), "vector-classes")
    classes, _ = stored(folded.select(F.col("node").alias("rep"), "n", "embedding")
                        .mapInArrow(_units, "rep bigint, n bigint, vector binary"), "unit-vectors")
    cells = spark.sparkContext.broadcast(_cells(classes))
    joined = (classes.mapInArrow(lambda b: _dealt(b, cells), _DEALT).groupBy("dim", "cell", "a", "b")
              .applyInPandas(join_blocks, "rep bigint, links bigint, root bigint"))
    joined, _ = stored(joined, "joined-cells")
    node_of = src.filter("k1 is not null and vec_id is not null").select("vec_id", F.xxhash64("k1", "k2").alias("node"))
    same = node_of.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("vec_id", "a")
    same = node_of.join(same, "vec_id").select("a", F.col("node").alias("b"))
    component = connected_components(joined.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
                                     .unionByName(same), "a", "b").withColumnRenamed("vertex", "node")
    smallest = (component.join(folded.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("smallest")))
    links = joined.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("links"))
    found = (folded.select("k1", "k2", "node", "n", "rep").join(links, "node", "left").join(component, "node", "left")
             .join(smallest, "component", "left").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("others"),
                                                         F.coalesce("smallest", "rep").alias("smallest")))
    component_id = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return (src.select("vec_id", "k1", "k2").join(found, ["k1", "k2"], "left")
            .select("vec_id", F.coalesce("others", F.lit(0)).cast("bigint").alias("n_links"), component_id.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())))
