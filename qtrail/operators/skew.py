"""Heavy keys and where to cut them.

Work that needs the rows of a key together (a window, a trace) is dealt by the key.  That
is even as long as no key holds more than a task's share of the rows, the rows over the
shuffle partitions.  Keys above it are found by a frequent-items sketch (one pass over the
key columns, one row per task leaves it) and their rows are cut, in their order, into
pieces of about a share each.  A key of any size then spreads over tasks, all other keys
stay whole, and there are at most twice as many pieces as partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

SAMPLED = 64  # rows of a heavy key that are looked at for each of its pieces
_TRACKED = 32  # sketch entries for each partition: an estimate is off by about a ninth of a share at most
HASH = "_key_hash"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_hash(cols) -> Column:
    """One number for a key of any types; a light key that shares it with a heavy one is cut as well."""
    return F.xxhash64(*[F.col(c) for c in cols])


def _sketch(cols, parts: int) -> list[Column]:
    tracked = min(1_000_000, max(1024, _TRACKED * parts))
    hashed = F.call_function("approx_top_k", key_hash(cols), F.lit(min(2 * parts, tracked)), F.lit(tracked))
    return [F.count(F.lit(1)).alias("n"), hashed.alias("top")]


def _heavy(n: int, top, parts: int) -> tuple[dict[int, int], int]:
    return {t["item"]: t["count"] for t in top or [] if t["count"] * parts > n}, n


def heavy_keys(df: DataFrame, cols, parts: int | None = None) -> tuple[dict[int, int], int]:
    """({hash of the key: about its rows} for keys of more than a ``parts``-th of the rows, all rows)."""
    parts = parts or partitions(df.sparkSession)
    found = df.agg(*_sketch(cols, parts)).first()
    return _heavy(found["n"], found["top"], parts)


def written(df: DataFrame, cols, name: str = "keyed") -> tuple[DataFrame, tuple[dict[int, int], int]]:
    """``df`` written once, and its heavy keys, sketched by the tasks that write it: for rows
    that are costly to make (a parse, a shuffle), which no second pass should make again."""
    parts, seen = partitions(df.sparkSession), Observation()
    table = materialize(df.observe(seen, *_sketch(cols, parts)), name)
    return table, _heavy(seen.get["n"], seen.get["top"], parts)


def cut_points(df: DataFrame, cols, order, heavy=None, parts: int | None = None) -> DataFrame | None:
    """For each heavy key its hash and the ordered places (structs of ``order``) where its rows
    are cut, or None if no key is heavy.  At most 2 * ``parts`` places in all, written, so that
    every reader sees the same.  ``heavy``: what ``heavy_keys`` says, if known.  Runs jobs;
    the places only steer the work."""
    parts = parts or partitions(df.sparkSession)
    heavy, n = heavy or heavy_keys(df, cols, parts)
    if not heavy:
        return None
    rows = sum(heavy.values())
    pieces = {h: math.ceil(c * parts / n) for h, c in heavy.items()}
    share = min(1.0, SAMPLED * sum(pieces.values()) / rows)
    sample = (df.select(key_hash(cols).alias(HASH), F.struct(*order).alias("_place")).filter(F.col(HASH).isin(list(heavy)))
              .sample(share, 11).groupBy(HASH).agg(F.sort_array(F.collect_list("_place")).alias("_seen")))  # SAMPLED rows a piece
    want = F.element_at(F.create_map(*[F.lit(x) for item in pieces.items() for x in item]), F.col(HASH))
    steps = F.sequence(F.lit(1), want - 1)
    cuts = F.when(want > 1, F.array_distinct(F.transform(steps, lambda i: F.get("_seen", F.floor(i * F.size("_seen") / want).cast("int")))))
    return materialize(sample.select(HASH, F.coalesce(cuts, F.slice("_seen", 1, 0)).alias("_cuts")), "cut-points")


def piece_of(order) -> Column:
    """Number of cuts at or before a row (0 for the rows of a key that is not cut)."""
    place = F.struct(*order)
    return F.coalesce(F.size(F.filter("_cuts", lambda cut: cut <= place)), F.lit(0))


def only_keys(rows: DataFrame, keys: DataFrame, column: str, heavy: dict[int, int]) -> DataFrame:
    """The rows whose ``column`` is among ``keys`` (one column of that name, distinct, written).

    Heavy values are judged where the rows lie, by a list of at most one value a partition;
    only the tail is joined, so that no task gets the rows of a heavy value, whether or not
    the keys are few enough to be sent to the rows."""
    if not heavy:
        return rows.join(keys, column, "left_semi")
    hot = key_hash([column]).isin(list(heavy))
    known = [r[0] for r in keys.filter(hot).select(column).collect()]
    return (rows.filter(hot & F.col(column).isin(known))
            .unionByName(rows.filter(~hot).join(keys.filter(~hot), column, "left_semi").select(rows.columns)))
