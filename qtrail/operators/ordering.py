"""Order-dependent building blocks: successor (W2/W4), dense position (W3/P22),
dense index over an arbitrary order (G1, W5, G6 numbering).

A window needs the rows it looks at in one task.  Here those are a *piece*, a range of
the order:

* with a key (``partition_by``) a piece is all rows of the key, unless the key holds
  more than a task's share of all rows: such keys are cut in their order (``skew``), so a
  case with a third of the log is spread over many tasks, also within one minute;
* without a key a piece is a ``block``, a column that is monotone in the order and bounded
  in size (an input split of the log file, 2**14 consecutive ids).

Rows are dealt by (key, piece) once.  What crosses a border between pieces is one carry
row for each piece of a cut key or each block - never one for each key - and is joined
back to the windowed rows without dealing them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..session import materialize
from .skew import HASH, cut_points, key_hash, piece_of

_PIECE, _CUT = "_piece", "_cut"


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _in_pieces(df: DataFrame, pb, order, block, heavy=None) -> tuple[DataFrame, bool]:
    """``df`` with its piece and whether that piece was cut; False: no piece is, every key is whole."""
    if not pb:
        if block is None:
            raise ValueError("an order without a key needs a block")
        return df.withColumns({_PIECE: _as_col(block), _CUT: F.lit(True)}), True
    cuts = cut_points(df, pb, order, heavy)
    if cuts is None:
        return df, False
    # a row for each key above a task's share: fewer than the shuffle partitions
    joined = df.withColumn(HASH, key_hash(pb)).join(F.broadcast(cuts), HASH, "left")
    return joined.withColumns({_PIECE: piece_of(order), _CUT: F.col("_cuts").isNotNull()}).drop(HASH, "_cuts"), True


def _packed(df: DataFrame, keys) -> DataFrame:
    """``df`` as ``(keys…, _payload struct of the other columns, piece, cut)``.

    Every branch that is cut from the windowed table then needs exactly the same
    columns at the window's exchange, so Spark reuses that exchange and the (often
    expensive) expressions below it run once per row."""
    others = [c for c in df.columns if c not in (*keys, _PIECE, _CUT)]
    return df.select(*keys, F.struct(*others).alias("_payload"), _PIECE, _CUT)


def _back(big: DataFrame, carry: DataFrame, pb) -> DataFrame:
    """Join the carry rows (one per piece) to the windowed rows."""
    renamed = carry.select(*[F.col(c).alias(f"_c_{c}") for c in [*pb, _PIECE]], *[c for c in carry.columns if c not in (*pb, _PIECE)])
    if not pb:  # by block, as the rows already lie
        return big.join(renamed, F.col(_PIECE) == F.col(f"_c_{_PIECE}"), "left").drop(f"_c_{_PIECE}")
    same = (F.col(_PIECE) == F.col(f"_c_{_PIECE}")) & F.col(_CUT)
    for c in pb:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    # one row per piece of a cut key: at most twice the shuffle partitions
    return big.join(F.broadcast(renamed), same, "left").drop(*[f"_c_{c}" for c in [*pb, _PIECE]])


def carry_rows(inner: DataFrame, pb, first: Column, carried: Column) -> DataFrame:
    """One row for each cut piece (``_PIECE``), taken at its first row."""
    return inner.filter(first & F.col(_CUT)).select(*pb, _PIECE, carried)


def with_successor(df: DataFrame, values, order=("seq",), block=None, partition_by=(), prefix: str = "next_",
                   heavy=None) -> DataFrame:
    """Add ``<prefix><v>`` = value of the next row in ``order`` (per ``partition_by``).

    The last row of a group gets nulls.  ``order`` must be a total order; ``block`` (not
    null, monotone in the order) is needed without ``partition_by``.  With it, heavy keys
    are looked for while this is built; ``heavy`` says them if they are known (``skew.written``)."""
    values, order, pb = _names(values), _names(order), _names(partition_by)
    keys = list(dict.fromkeys([*pb, *order]))
    placed, cut = _in_pieces(df, pb, order, block, heavy)
    if not cut:
        w = Window.partitionBy(*pb).orderBy(*order)
        return placed.select("*", *[F.lead(v).over(w).alias(prefix + v) for v in values])
    base = _packed(placed.select("*", *[F.col(v).alias("_v_" + v) for v in values]), keys)
    w = Window.partitionBy(*pb, _PIECE).orderBy(*order)
    # one window pass gives each row's successor inside its piece and marks the first row
    # of every piece; the carry rows are read from that pass
    inner = base.select("*", F.lead("_payload").over(w).alias("_next"), F.lag(F.lit(1)).over(w).isNull().alias("_first"))
    heads = carry_rows(inner, pb, F.col("_first"), F.col("_payload").alias("_head"))
    following = F.lead("_head").over(Window.partitionBy(*pb).orderBy(_PIECE))
    joined = _back(inner, heads.select(*pb, _PIECE, following.alias("_carried")), pb)
    nxt = F.coalesce(F.col("_next"), F.col("_carried"))
    cols = [F.col(c) if c in keys else F.col("_payload")[c].alias(c) for c in df.columns]
    return joined.select(*cols, *[nxt["_v_" + v].alias(prefix + v) for v in values])


def _orderable(dtype: Ty.DataType) -> bool:
    if isinstance(dtype, Ty.MapType):
        return False
    if isinstance(dtype, Ty.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, Ty.ArrayType):
        return _orderable(dtype.elementType)
    return True


def with_position(df: DataFrame, order=("seq",), block=None, partition_by=(), name: str = "pos",
                  start: int = 0, total: str | None = None, heavy=None) -> DataFrame:
    """Add a dense position (``start``, ``start+1``, …) in ``order`` per ``partition_by``;
    with ``total``, also the number of rows of the group.  ``order``, ``block`` and
    ``heavy`` as in ``with_successor``.

    Cut rows are also ordered by the packed payload after ``order``; ``order`` is total,
    so this never changes a position, but it makes the carry rows read the same columns
    as the rows themselves (one shared exchange)."""
    order, pb = _names(order), _names(partition_by)
    if total is not None and not pb:
        raise ValueError("total needs partition_by (the total of the whole table is df.count())")
    keys = list(dict.fromkeys([*pb, *order]))
    placed, cut = _in_pieces(df, pb, order, block, heavy)
    if not cut:
        w = Window.partitionBy(*pb)
        extra = [F.count(F.lit(1)).over(w).alias(total)] if total is not None else []
        return placed.select("*", (F.row_number().over(w.orderBy(*order)) + (start - 1)).cast("bigint").alias(name), *extra)
    base = _packed(placed, keys)
    tie = ["_payload"] if _orderable(base.schema["_payload"].dataType) else []
    w = Window.partitionBy(*pb, _PIECE)
    inner = base.select("*", F.row_number().over(w.orderBy(*order, *tie)).alias("_rn"), F.count(F.lit(1)).over(w).alias("_size"))
    sizes = carry_rows(inner, pb, F.col("_rn") == 1, F.col("_size").alias("_n"))
    group = Window.partitionBy(*pb)
    before = F.sum("_n").over(group.orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1))
    joined = _back(inner, sizes.select(*pb, _PIECE, before.alias("_before"), F.sum("_n").over(group).alias("_all")), pb)
    out = [F.col(c) if c in keys else F.col("_payload")[c].alias(c) for c in df.columns]
    extra = [F.coalesce("_all", "_size").cast("bigint").alias(total)] if total is not None else []
    place = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_rn") - 1 + start
    return joined.select(*out, place.cast("bigint").alias(name), *extra)


def with_running(df: DataFrame, sums: dict[str, Column], order, block, within: Column) -> DataFrame:
    """Add for each name the sum of its expression over the rows before, in ``order``, of the
    same ``within`` (a group of whole blocks, such as their file).

    ``order``, ``block`` as in ``with_successor``.  Sums run inside a block; one row per block
    carries them on."""
    order, names = _names(order), list(sums)
    base = df.select("*", *[e.cast("bigint").alias("_r_" + n) for n, e in sums.items()], _as_col(block).alias(_PIECE), within.alias("_group"))
    w = Window.partitionBy(_PIECE).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    inner = base.select("*", *[F.coalesce(F.sum("_r_" + n).over(before), F.lit(0)).alias(n) for n in names])
    totals = base.groupBy(_PIECE).agg(F.first("_group").alias("_group"), *[F.sum("_r_" + n).alias("_t_" + n) for n in names])
    upto = Window.partitionBy("_group").orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    carried = totals.select(F.col(_PIECE).alias("_c_piece"), *[F.coalesce(F.sum("_t_" + n).over(upto), F.lit(0)).alias("_c_" + n) for n in names])
    joined = inner.join(carried, F.col(_PIECE) == F.col("_c_piece"))
    return joined.select(*df.columns, *[(F.col(n) + F.col("_c_" + n)).alias(n) for n in names])


def dense_index(df: DataFrame, order, name: str = "idx", start: int = 0) -> DataFrame:
    """Add ``name`` = 0-based (+``start``) rank of each row in ``order`` (a total order).

    Range-partitions on the order, numbers rows inside each partition, writes
    that to the shared checkpoint folder so the numbering is fixed, then adds
    the per-partition offsets (a table with one row per partition, broadcast)."""
    order = [order] if isinstance(order, str) else list(order)
    tagged = materialize(df.repartitionByRange(*[_as_col(o) for o in order])
                         .sortWithinPartitions(*order)
                         .select("*", F.spark_partition_id().alias("_pid"),
                                 F.monotonically_increasing_id().alias("_mid")), "dense-index")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .select(*df.columns, (F.col("_off") + local + start).cast("bigint").alias(name)))
