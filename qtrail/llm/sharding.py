"""Operator 11: shards along a Hilbert curve over metadata (DataFrame functions only).

Every metadata dimension is quantised to 2**bits cells of about equally many rows, the
cells of a row are its point on a grid, the Hilbert curve visits the grid so that
neighbours on the curve are neighbours in every dimension, and the curve is cut into
``shards`` runs whose row counts differ by at most one (law ``rows``).  A shard then
spans a narrow range of each dimension, so the minima and maxima of its files let a
reader skip most shards (``write_shards``, ``manifest``).

1. one aggregation reads the range of every dimension, a second counts 2**16 *fine*
   steps of it: numbers on a logarithmic scale, texts by six bytes behind the prefix
   that all values share.  The counts cover all rows and are at most 65,537 for a
   dimension, whatever the data; their running sums give the cells;
2. a row's fine steps are looked up in these bounded tables (broadcast) and its curve
   index follows from one table of the curve's turns;
3. rows are range-partitioned and sorted by (curve, id, hashes of the row, place); the
   place parts rows that are equal in everything, so a key that a third of all rows
   share is spread.  Row counts per partition give the ranks (``dense_index``).

``docs`` must be a table read from files (a computed one is written first), so that a
task that runs again sees its rows at the same places.

Defined results: null and NaN lie before all other values of a dimension; a dimension
without two values takes no part in the order; rows of one cell go by id (nulls
first), then by hash; equal rows are rows of their own; an empty table gives no row;
columns of ``docs`` named like a result column are replaced, all others are passed on.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import dense_index

DIMENSIONS = ("lang", "source", "n_chars")
SHARDS, BITS = 8, 10
FINE = 1 << 16
_PREFIX = 1024  # characters of a text that are looked at for a common prefix
_CODE = 6       # bytes of a text that order it


def curve_turns(dims: int) -> list[int]:
    """The curve as a table: entry ``state * 2**dims + corner`` is ``state' * 2**dims + step``.

    A state is the corner where the curve enters a cube and the axis along which it
    leaves it (Hamilton's formulation: ``corner`` reflected and rotated to the standard
    cube, ranked by the inverse Gray code)."""
    size = 1 << dims

    def rotate(v, by):
        by %= dims
        return ((v << by) | (v >> (dims - by))) & (size - 1)

    def gray(v):
        return v ^ (v >> 1)

    rank = {gray(v): v for v in range(size)}

    def ones(v):  # trailing one bits
        return 0 if v & 1 == 0 else 1 + ones(v >> 1)

    table = []
    for entry in range(size):
        for axis in range(dims):
            for corner in range(size):
                step = rank[rotate(corner ^ entry, -(axis + 1))]
                enters = gray(2 * ((step - 1) // 2)) if step else 0
                turn = 0 if step == 0 else ones(step - 1 if step % 2 == 0 else step) % dims
                state = (entry ^ rotate(enters, axis + 1)) * dims + (axis + turn + 1) % dims
                table.append(state * size + step)
    return table


def curve_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point given by its cell in each dimension."""
    dims = len(cells)
    size = 1 << dims
    turns = F.array(*[F.lit(t) for t in curve_turns(dims)])

    def corner(level):
        out = F.lit(0)
        for d, cell in enumerate(cells):
            out = out + F.call_function("shiftleft", F.call_function("shiftright", cell, level).bitwiseAND(1).cast("int"), F.lit(d))
        return out

    def step(at, here):
        turned = F.get(turns, at["state"] * size + here)
        return F.struct((at["index"] * size + turned % size).cast("bigint").alias("index"), F.floor(turned / size).cast("int").alias("state"))

    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).cast("int").alias("state"))
    levels = F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), corner)
    return F.aggregate(levels, start, step, lambda at: at["index"])


def _text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BinaryType))


def _number(name: str, kind: T.DataType) -> Column:
    """A double that orders the values as they are, on a logarithmic scale; null for null and NaN."""
    c = F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, T.BooleanType):
        c = c.cast("int")
    c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return F.signum(c) * F.log1p(F.least(F.abs(c), F.lit(1e308)))


def _code(name: str, skip: int) -> Column:
    """The ``_CODE`` bytes behind the first ``skip`` as a number."""
    part = F.substring(F.col(name).cast("binary"), skip + 1, _CODE)
    return F.conv(F.rpad(F.hex(part), 2 * _CODE, "0"), 16, 10).cast("double")


def _fine_steps(docs: DataFrame, dims) -> tuple[int, list[Column]]:
    """Number of rows, and for each dimension its fine step (0: null) as an expression."""
    kinds = {d: docs.schema[d].dataType for d in dims}
    cut = {d: F.substring(F.col(d).cast("binary"), 1, _PREFIX) if _text(kinds[d]) else _number(d, kinds[d]) for d in dims}
    ends = docs.agg(F.count(F.lit(1)).alias("n"), *[f(cut[d]).alias(f"{k}{i}") for i, d in enumerate(dims) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i, d in enumerate(dims):
        low, high = ends[f"lo{i}"], ends[f"hi{i}"]
        if low is None or low == high:
            out.append(F.lit(0))
            continue
        value = cut[d]
        if _text(kinds[d]):
            low, high = bytes(low), bytes(high)
            skip = len(os.path.commonprefix([low, high]))
            value = _code(d, skip)
            low, high = (float(int.from_bytes(x[skip:skip + _CODE].ljust(_CODE, b"\0"), "big")) for x in (low, high))
        step = F.floor((value - F.lit(low)) / F.lit(high - low) * (FINE - 1)) if high > low else F.lit(0)
        out.append(F.when(value.isNull(), 0).otherwise(step.cast("int") + 1))
    return ends["n"], out


def _cells(docs: DataFrame, fine: list[Column], n: int, bits: int) -> DataFrame:
    """(dim, fine, cell): cells of about equally many rows; at most FINE + 1 rows for a dimension."""
    from pyspark.sql import Window
    pairs = F.array(*[F.struct(F.lit(i).alias("dim"), f.alias("fine")) for i, f in enumerate(fine)])
    counts = docs.select(F.inline(pairs)).groupBy("dim", "fine").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("dim").orderBy("fine"))  # bounded: the steps of a dimension
    return counts.select("dim", "fine", F.floor((upto * 2 - F.col("c")) * (1 << bits) / (2 * n)).cast("int").alias("cell"))


RESULT = ("curve", "shard", "slot")


def hilbert_shards(docs: DataFrame, dims=DIMENSIONS, id_col: str = "doc_id", shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``docs`` with ``curve`` (place on the curve), ``shard`` and ``slot`` (place in the
    shard, gapless from 0).  Runs jobs while it is built."""
    if not 1 <= len(dims) <= 6 or len(dims) * bits > 62:
        raise ValueError("one to six dimensions and at most 62 bits in all")
    docs = docs.drop(*RESULT)
    n, fine = _fine_steps(docs, dims)
    if not n:
        return docs.select("*", F.lit(0).cast("bigint").alias("curve"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    cells = _cells(docs, fine, n, bits)
    keyed = docs.select("*", *[f.alias(f"_hs_f{i}") for i, f in enumerate(fine)])
    for i in range(len(dims)):
        of = cells.filter(F.col("dim") == i).select(F.col("fine").alias(f"_hs_f{i}"), F.col("cell").alias(f"_hs_c{i}"))
        keyed = keyed.join(F.broadcast(of), f"_hs_f{i}")  # FINE + 1 rows at most
    own = F.xxhash64(*[F.col(c) for c in docs.columns])
    order = {"_hs_curve": curve_index([F.col(f"_hs_c{i}") for i in range(len(dims))], bits), "_hs_id": F.col(id_col), "_hs_own": own,
             "_hs_place": F.monotonically_increasing_id()}
    ranked = dense_index(keyed.select(*docs.columns, *[c.alias(k) for k, c in order.items()]), list(order), name="_hs_rank")
    shard = F.expr(f"_hs_rank * {shards} div {n}")
    first = F.expr(f"(_hs_shard * {n} + {shards - 1}) div {shards}")
    return (ranked.withColumn("_hs_shard", shard)
            .select(*docs.columns, F.col("_hs_curve").alias("curve"), F.col("_hs_shard").cast("int").alias("shard"),
                    (F.col("_hs_rank") - first).cast("bigint").alias("slot")))


def manifest(placed: DataFrame, dims=DIMENSIONS) -> DataFrame:
    """One row per shard: its rows and the smallest and largest value of every dimension."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))],
                                       *[F.count_if(F.col(d).isNull()).alias(f"nulls_{d}") for d in dims])


def write_shards(placed: DataFrame, folder: str) -> None:
    """One folder ``shard=k`` a shard, its files cut along the curve, so that the minima and
    maxima that Parquet keeps for row groups are as narrow as the run."""
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(folder))
