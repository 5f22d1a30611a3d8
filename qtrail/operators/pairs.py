"""Consecutive-template mining.

One pass over the events: each event gets its successor (``ordering.with_successor``),
then a single hash
aggregation on ``(normalized_query, next_query)`` that also keeps the
``next_query IS NULL`` group.  Pair counts are the non-null groups; the total
per template (A9, which counts the last event too) is the sum over all its
groups, taken on the pair-count table and summed before it is shuffled, so a template
with very many successors is no task of its own.  The events are scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import only_valid, statements, valid_events
from .ordering import with_successor
from .skew import written


def template_events(log: DataFrame, valid: DataFrame | None = None, exclude_echo: bool = False, rule=None,
                    keep=("ts", "line")) -> DataFrame:
    """Statement events (unspaced keyword test, F4c) whose template is valid (J1): in ``valid``,
    or by ``rule`` = (max_count, max_share) of the log itself (then ``keep`` are the columns kept besides)."""
    if rule is not None:
        return valid_events(log, *rule, exclude_echo=exclude_echo, keep=keep)
    ev = statements(log, spaced=False, exclude_echo=exclude_echo).select("seq", "block", "ts", "line",
                                                                        "normalized_query")
    return only_valid(ev, valid)


def successor_counts(events: DataFrame, query: str = "normalized_query", order=("seq",), block="block",
                     partition_by=(), costly: bool = False) -> DataFrame:
    """``(normalized_query, next_query, count)`` including the null successor group.

    ``costly``: the events are made by a parse; with a key they are written once, so that
    the look for heavy keys does not parse them again."""
    order = [order] if isinstance(order, str) else list(order)
    pb = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    # only the columns the stitch needs: every branch of the plan then shares
    # one exchange of the events instead of re-reading the source per branch
    blk = F.col(block) if isinstance(block, str) else block
    narrow = events.select(*dict.fromkeys([*pb, *order, query]), *([] if pb else [blk.alias("_block")]))
    narrow, heavy = written(narrow, pb, "case-events") if pb and costly else (narrow, None)
    nxt = with_successor(narrow, [query], order=order, block=None if pb else "_block", partition_by=pb, prefix="_next_", heavy=heavy)
    return (nxt.groupBy(F.col(query).alias("normalized_query"), F.col("_next_" + query).alias("next_query"))
            .agg(F.count(F.lit(1)).alias("count")))


def _with_totals(kept: DataFrame, counts: DataFrame) -> DataFrame:
    """The pairs ``kept`` of ``counts`` with ``total_count`` of the first template (A9 + J2).

    The total is the sum over all successor groups of the template, the null
    (last event) group included: the reference's join with per-template counts,
    from one aggregation of the events.  Only pairs that stay meet their total;
    both sides read the one exchange of the pair counts."""
    totals = counts.groupBy(F.col("normalized_query").alias("_first")).agg(F.sum("count").alias("total_count"))
    return kept.join(totals, F.col("normalized_query").eqNullSafe(F.col("_first"))).drop("_first")


def consecutive_pairs(log: DataFrame, valid: DataFrame | None = None, threshold: int = 300,
                      exclude_echo: bool = False, partition_by=(), sort: bool = False,
                      min_share: float | None = None, rule=None) -> DataFrame:
    """X1 ``extract_consecutive_pairs``: pairs of consecutive valid templates in
    file order occurring more than ``threshold`` times and more than ``min_share`` of
    all events (both strict; None does not apply).

    Faithful default keeps echo lines (``exclude_echo=False``) and uses the
    global order; ``partition_by`` (e.g. ``"case_id"``) restricts pairs to one case."""
    ev = template_events(log, valid, exclude_echo, rule, keep=("line",) if partition_by else ())
    ev = _with_case(ev, partition_by)
    counts = successor_counts(ev, partition_by=partition_by, costly=True)
    out = _above(counts, threshold, min_share).select("normalized_query", "next_query", "count")
    return out.orderBy(F.desc("count"), "normalized_query", "next_query") if sort else out


def pair_confidence(log: DataFrame, valid: DataFrame | None = None, threshold: int = 300,
                    exclude_echo: bool = True, partition_by=(), sort: bool = False,
                    min_share: float | None = None, rule=None) -> DataFrame:
    """X2 ``compute_confidence``: frequent pairs with ``total_count`` of the first
    template and ``confidence = count / total_count``.

    Columns ``normalized_query, next_query, count, total_count, confidence``."""
    ev = template_events(log, valid, exclude_echo, rule, keep=("line",) if partition_by else ())
    ev = _with_case(ev, partition_by)
    counts = successor_counts(ev, partition_by=partition_by, costly=True)
    return confidence_from_counts(counts, threshold, sort, min_share)


def _above(counts: DataFrame, threshold: int, min_share: float | None) -> DataFrame:
    """Pairs (with a successor) above both bounds; the share is of all events, the null group included.

    The test of the successor is tied to the count: a filter of the key alone would be moved below
    the aggregation, which the totals need as a whole, and the events would be read once more."""
    kept = counts.filter(F.col("count") * F.col("next_query").isNotNull().cast("bigint") > max(threshold, 0))
    if min_share is None:
        return kept
    everything = counts.agg(F.sum("count")).scalar()  # one number, summed on the map side first
    return kept.filter(F.col("count") > F.lit(float(min_share)) * everything)


def confidence_from_counts(counts: DataFrame, threshold: int, sort: bool = False,
                           min_share: float | None = None) -> DataFrame:
    out = (_with_totals(_above(counts, threshold, min_share), counts)
           .select("normalized_query", "next_query", "count", "total_count",
                   (F.col("count") / F.col("total_count")).alias("confidence")))
    return out.orderBy(F.desc("confidence"), "normalized_query", "next_query") if sort else out


def sequence_confidence(events: DataFrame, case: str | None, query: str, order, block=None, threshold: int = 0,
                        sort: bool = False) -> DataFrame:
    """X2 over any ordered event table: ``case`` (or None for one global
    sequence, which needs ``block``: a bounded key monotone in the order),
    ``query`` the activity, ``order`` a total order."""
    pb = [case] if case else []
    counts = successor_counts(events, query=query, order=order, block=block, partition_by=pb)
    return confidence_from_counts(counts, threshold, sort)


def _with_case(ev: DataFrame, partition_by) -> DataFrame:
    from ..functions import text as T
    pb = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    if "case_id" in pb and "case_id" not in ev.columns:
        ev = ev.withColumn("case_id", T.case_id("line"))
    return ev
