"""Operator 13: hard negatives by rotated one-bit codes.

Vectors become integers, a row's score against an anchor is their integer inner
product.  An anchor's positives are its ``POSITIVES`` best rows of the same label; for
each of them the ``NEGATIVES`` best rows of another label are sought whose score lies in
a window below the positive's.

1. Codes.  A vector is rotated (signs, then Hadamard) and one bit per dimension, the
   sign, is kept, with its *alignment* a = <code direction, vector> and the norm of what
   is left: x = a * o + r, r orthogonal to the direction o.  What is left is coded again
   under another rotation, ``LEVELS`` times.
2. Estimate.  A query is rotated as integers and cut into bit planes, so <o, q> comes
   exactly from popcounts of code AND plane.  Then <x, q> = sum of a * <o, q> + <r, q>, and
   by Cauchy-Schwarz |<r, q>| <= |r| * sqrt(|q|^2 - <o, q>^2): an interval that holds the
   score for certain, narrower with every level.
3. Filter.  A row whose interval ends below the k-th best lower end, or misses every
   window, is out after the level that shows it; only the rest is scored by integers.
   Nothing is lost, whatever the codes are.

Anchors and rows are dealt by hash over blocks of about ``ANCHORS`` and ``ROWS``; one task
holds a block of each and gives out the best few rows of every anchor, so the output
of a task is bounded however many rows tie or share a vector.  The work is anchors x
rows, as an exact search over a stated query set is; the rows travel once for each
``ANCHORS`` anchors and the anchors once for each ``ROWS`` rows.  Two passes: positives
first, as their scores set the windows.

Defined results: rows with a null label, a null or empty vector or a null or
non-finite entry take no part; rows equal in id, label and integer vector are one row;
other rows that share an id are rows of their own; a null id is no anchor and comes
last among equal scores; vectors of unequal length do not meet; entries are held
within +-2**50, a score beyond a long counts as the nearest long; a positive without a
row in its window gives no row; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import U64, mix, stored

SCALE, LEVELS = 256, 6
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # the window, in hundredths of the positive's score
ANCHORS, ROWS = 2048, 8192
MOST = 1 << 50
_EXACT, _LONG = 1 << 53, (1 << 63) - 1


def _padded(dim: int) -> int:
    return max(8, 1 << (dim - 1).bit_length())


def hadamard(a: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform along the last axis (a power of two)."""
    half = 1
    while half < a.shape[-1]:
        pairs = a.reshape(*a.shape[:-1], -1, 2, half)
        a = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(a.shape)
        half *= 2
    return a


def signs(level: int, size: int) -> np.ndarray:
    return np.where(mix(np.arange(size, dtype=U64) + U64((level + 1) << 32)) >> U64(63), -1, 1).astype(np.int64)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    short = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, short)])).view(U64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, norms of what is left) by row and level."""
    rows, dim = vectors.shape
    size = _padded(dim)
    rest = np.zeros((rows, size))
    rest[:, :dim] = vectors
    codes, along, left = [], [], []
    for level in range(LEVELS):
        turned = hadamard(rest * signs(level, size))
        bit = turned >= 0
        a = np.abs(turned).sum(axis=1) / size
        rest = rest - a[:, None] * (hadamard(np.where(bit, 1.0, -1.0)) * signs(level, size) / size)
        codes.append(pack(bit))
        along.append(a)
        left.append(np.linalg.norm(rest, axis=1))
    return np.stack(codes, 1), np.stack(along, 1), np.stack(left, 1)


class Queries:
    """The anchors of a block: bit planes of all rotations of all of them."""

    def __init__(self, vectors: np.ndarray):
        count, dim = vectors.shape
        self.size = _padded(dim)
        self.vectors = vectors
        self.norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
        whole = np.zeros((count, 1, self.size), np.int64)
        whole[:, 0, :dim] = vectors
        turned = hadamard(whole * np.stack([signs(level, self.size) for level in range(LEVELS)]))
        self.least, self.total = turned.min(axis=2), turned.sum(axis=2).astype(np.float64)
        above = turned - self.least[..., None]
        bits = max(1, int(above.max(initial=0)).bit_length())
        self.weights = (2.0 ** np.arange(bits)).astype(np.float32 if self.size << bits < 1 << 24 else np.float64)  # exact sums
        self.planes = np.stack([pack((above >> p & 1).astype(bool)) for p in range(len(self.weights))], axis=2)  # anchor, level, plane, word

    def along(self, query: int, level: int, codes: np.ndarray) -> np.ndarray:
        """<direction of each code, query>, from popcounts."""
        planes, ones, held = self.planes[query, level], 0.0, 0.0
        for word in range(codes.shape[1]):
            ones = ones + np.bitwise_count(codes[:, word])
            held = held + (np.bitwise_count(codes[:, word, None] & planes[:, word]) @ self.weights).astype(np.float64)
        return (2 * (held + float(self.least[query, level]) * ones) - self.total[query, level]) / self.size


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    most = int(np.abs(query).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(len(query), 1)
    if most < _EXACT:  # every partial sum is an integer that a double holds
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return np.array([max(min(int(s), _LONG), -_LONG) for s in vectors.astype(object) @ query.astype(object)], np.int64)


class Block:
    """Rows of one task."""

    def __init__(self, rows: pd.DataFrame, dim: int):
        n = len(rows)
        self.vectors = np.frombuffer(b"".join(rows["x"]), "<i8").reshape(n, dim)
        self.codes = np.frombuffer(b"".join(rows["codes"]), "<u8").reshape(n, LEVELS, -1).transpose(1, 0, 2).copy()
        parts = np.frombuffer(b"".join(rows["parts"]), "<f8").reshape(n, 2, LEVELS)
        self.along, self.left = parts[:, 0].T.copy(), parts[:, 1].T.copy()
        self.norms = np.linalg.norm(self.vectors.astype(np.float64), axis=1)
        self.labels, self.rid = rows["label"].to_numpy(np.int64), rows["rid"].to_numpy(np.int64)
        self.ids = rows["vec_id"].to_numpy(np.int64)  # null travels as the largest long: behind all others
        self.scored = 0

    def narrowed(self, queries: Queries, query: int, rows: np.ndarray, keep) -> np.ndarray:
        """Of ``rows``, those that ``keep(low, high)`` - certain ends of their scores - leaves after every level."""
        estimate = np.zeros(len(rows))
        low, high = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        norm = queries.norms[query]
        slack = 1e-9 * norm * self.norms[rows] + 1e-6
        for level in range(LEVELS):
            if not len(rows):
                break
            o = queries.along(query, level, self.codes[level, rows])
            estimate = estimate + self.along[level, rows] * o
            if level == 0 and LEVELS > 1:
                continue  # one code alone parts few rows
            half = self.left[level, rows] * np.sqrt(np.maximum(norm ** 2 - o * o, 0)) + slack
            low, high = np.maximum(low, estimate - half), np.minimum(high, estimate + half)
            stay = keep(low, high)
            if not stay.all():
                rows, estimate, low, high, slack = rows[stay], estimate[stay], low[stay], high[stay], slack[stay]
        self.scored += len(rows)
        return rows

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``rows`` of the k first: higher score, then smaller id."""
        if len(rows) > 4 * k + 64:  # most rows are far off
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        else:
            near = np.arange(len(rows))
        return near[np.lexsort((self.rid[rows[near]], self.ids[rows[near]], -scores[near]))[:k]]


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def positives(block: Block, queries: Queries, query: int, label: int, own: tuple, k: int) -> list[tuple]:
    """(score, place) of the k best rows of the label in the block, without the anchor itself."""
    rows = np.flatnonzero((block.labels == label) & ~((block.rid == own[1]) & (block.ids == own[0])))
    rows = block.narrowed(queries, query, rows, lambda low, high: high >= _kth(low, k))
    scores = exact_scores(queries.vectors[query], block.vectors[rows])
    return [(int(scores[i]), int(rows[i])) for i in block.best(rows, scores, k)]


def negatives(block: Block, queries: Queries, query: int, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple]]:
    """For each window (lowest, highest score): (score, place) of the k best rows of other labels in it."""
    windows = [(float(lo), float(hi)) for lo, hi in windows]

    def keep(low, high):
        stay = np.zeros(len(low), bool)
        for lo, hi in windows:
            sure = _kth(low[(low >= lo) & (high <= hi)], k)
            stay |= (high >= max(lo, sure)) & (low <= hi)
        return stay

    rows = block.narrowed(queries, query, np.flatnonzero(block.labels != label), keep)
    scores = exact_scores(queries.vectors[query], block.vectors[rows])
    out = []
    for lo, hi in windows:
        inside = np.flatnonzero((scores >= lo) & (scores <= hi))
        out.append([(int(scores[inside[i]]), int(rows[inside[i]])) for i in block.best(rows[inside], scores[inside], k)])
    return out


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _encoded(batches):
    for batch in batches:
        raw = batch.column("x")
        ends, flat = raw.offsets.to_numpy(), raw.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(ends)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            for part in (at[i:i + 2048] for i in range(0, len(at), 2048)):
                x = np.ascontiguousarray(flat[ends[part][:, None] + np.arange(dim)], "<i8")
                codes, along, left = encode(x.astype(np.float64))
                parts = np.ascontiguousarray(np.stack([along, left], 1), "<f8")
                blob = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                take = pa.array(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(take) for c in ("vec_id", "label", "anchor", "rid")]
                    + [pa.array(np.full(len(part), dim, np.int32)), blob(x), blob(codes), blob(parts)], names=[c.split()[0] for c in _ROW.split(", ")])


_ROW = "vec_id bigint, label bigint, anchor boolean, rid bigint, dim int, x binary, codes binary, parts binary"
_FOUND = "anchor_id bigint, anchor_rid bigint, positive_id bigint, positive_rid bigint, positive_score bigint"


def _shown(block: Block, place: int):
    return None if block.ids[place] == _LONG else int(block.ids[place])


def _queries(anchors: pd.DataFrame) -> Queries:
    return Queries(np.frombuffer(b"".join(anchors["x"]), "<i8").reshape(len(anchors), -1))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame({n: pd.array([r[i] for r in rows], "Int64") for i, n in enumerate(names)})


def _positive_block(k: int):
    def run(key: tuple, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            block, queries = Block(rows, int(key[0])), _queries(anchors)
            for q, a in enumerate(anchors.itertuples()):
                for score, place in positives(block, queries, q, a.label, (a.vec_id, a.rid), k):
                    out.append((a.vec_id, a.rid, _shown(block, place), int(block.rid[place]), score))
        return _frame(out, _FOUND)
    return run


_MINED = _FOUND + ", negative_id bigint, negative_rid bigint, negative_score bigint"


def _negative_block(k: int, low: int, high: int):
    def run(key: tuple, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            block, queries = Block(rows, int(key[0])), _queries(anchors)
            for q, a in enumerate(anchors.itertuples()):
                chosen = [(p["positive_id"], p["positive_rid"], p["positive_score"]) for p in a.chosen]
                found = negatives(block, queries, q, a.label, [window(p[2], low, high) for p in chosen], k)
                out += [(a.vec_id, a.rid, *p, _shown(block, place), int(block.rid[place]), score)
                        for p, best in zip(chosen, found) for score, place in best]
        return _frame(out, _MINED)
    return run


def _first(found: DataFrame, key: list[str], kind: str, k: int) -> DataFrame:
    """The k first rows of every key (tasks have given k at most each), with their rank."""
    order = Window.partitionBy(*key).orderBy(F.desc(f"{kind}_score"), F.asc_nulls_last(f"{kind}_id"), f"{kind}_rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         scale: int = SCALE, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where ``anchor`` holds.
    Runs jobs while it is built."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    held = lambda c: F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(float(-MOST)))
    rows = (vectors.filter(usable & F.col(label_col).isNotNull())
            .select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LONG)).alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
                    F.transform(v, lambda c: F.floor(held(c))).alias("x"), F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"))
            .distinct().withColumn("rid", F.xxhash64("vec_id", "label", "x")))
    coded, _ = stored(rows.mapInArrow(_encoded, _ROW), "coded-vectors")
    n_rows, n_anchors = coded.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    across, down = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    lot = F.xxhash64("rid", F.lit(13))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    anchors = coded.filter("anchor").withColumn("a", F.pmod(lot, F.lit(across)))
    dealt = coded.drop("anchor").withColumn("b", F.pmod(lot, F.lit(down))).withColumn("a", every(across))

    def blocks(queries: DataFrame):
        queries = queries.withColumn("b", every(down))
        return queries.groupBy("dim", "a", "b").cogroup(dealt.groupBy("dim", "a", "b"))

    asking = anchors.select("dim", "a", "vec_id", "label", "rid", "x")
    found = blocks(asking).applyInPandas(_positive_block(n_positives), _FOUND)
    best = _first(found, ["anchor_id", "anchor_rid"], "positive", n_positives)
    chosen = best.groupBy("anchor_id", "anchor_rid").agg(F.collect_list(F.struct("positive_id", "positive_rid", "positive_score")).alias("chosen"))
    asking, _ = stored(asking.join(chosen, (F.col("vec_id") == F.col("anchor_id")) & (F.col("rid") == F.col("anchor_rid"))), "chosen-positives")
    mined = blocks(asking).applyInPandas(_negative_block(n_negatives, low, high), _MINED)
    first = _first(mined, ["anchor_id", "anchor_rid", "positive_id", "positive_rid"], "negative", n_negatives)
    return first.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
