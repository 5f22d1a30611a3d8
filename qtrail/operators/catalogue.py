"""Template, case, table and entity catalogues.

Inputs are ordered event tables ``(seq, block, ts, line)``.  All operators are
filters + Catalyst expressions + hash aggregation (partial aggregation on the
map side), so they scale with the number of executors; the only sorts are the
optional presentation sorts of ``sort=True``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..session import materialize
from .mentions import mentions
from .ordering import with_position
from .skew import only_keys, written


def _sorted(df: DataFrame, sort: bool, *keys) -> DataFrame:
    return df.orderBy(*keys) if sort else df


def statements(log: DataFrame, spaced: bool = True, exclude_echo: bool = True) -> DataFrame:
    """Statement lines with their template: adds ``normalized_query``."""
    df = log
    if exclude_echo:
        df = df.filter(P.not_echo("line"))
    return (df.filter(P.is_statement("line", spaced=spaced))
            .withColumn("normalized_query", T.normalize_query("line")))


def template_counts(log: DataFrame, sort: bool = False) -> DataFrame:
    """A3 ``count_unique_queries``: occurrences of each non-empty template.

    Columns ``normalized_query, count``; ``sort`` orders by count desc."""
    counts = (statements(log, spaced=True, exclude_echo=True)
              .filter(P.found("normalized_query"))
              .groupBy("normalized_query").agg(F.count(F.lit(1)).alias("count")))
    return _sorted(counts, sort, F.desc("count"), "normalized_query")


def valid_templates(log: DataFrame, max_count: int | None = 500, max_share: float | None = None) -> DataFrame:
    """Templates rarer than ``max_count`` (strict) and than ``max_share`` of all
    template occurrences (strict; a ceiling that follows the log's size); a bound
    that is None does not apply."""
    return _rare(template_counts(log), max_count, max_share)


def _rare(counts: DataFrame, max_count: int | None, max_share: float | None) -> DataFrame:
    if max_share is not None:
        everything = counts.agg(F.sum("count")).scalar()  # one number, summed on the map side first
        counts = counts.filter(F.col("count") < F.lit(float(max_share)) * everything)
    if max_count is not None:
        counts = counts.filter(F.col("count") < max_count)
    return counts.select("normalized_query")


def valid_events(log: DataFrame, max_count: int | None = 500, max_share: float | None = None, exclude_echo: bool = True,
                 keep=("ts", "line")) -> DataFrame:
    """J1 by the rule of ``valid_templates``: statement events (F4c) of valid templates, ``(seq, block, keep…,
    normalized_query)``.

    The log is parsed once: its events are written with a mark for those that X3 counts,
    and the tasks that write them sketch which templates are frequent.  The valid set is
    counted on the written events; frequent templates are judged where they lie.  Runs
    jobs while it is built."""
    events = statements(log, spaced=False, exclude_echo=exclude_echo)
    counted = P.not_echo("line") & P.is_statement("line", spaced=True) & P.found("normalized_query")
    columns = list(dict.fromkeys(["seq", "block", *keep, "normalized_query"]))
    table, (heavy, _) = written(events.select(*columns, counted.alias("_counted")), ["normalized_query"], "events")
    counts = table.filter("_counted").groupBy("normalized_query").agg(F.count(F.lit(1)).alias("count"))
    valid = materialize(_rare(counts, max_count, max_share), "valid")
    return only_keys(table.select(columns), valid, "normalized_query", heavy)


def write_events(log: DataFrame, spaced: bool = True, exclude_echo: bool = True, extra_markers=()) -> DataFrame:
    """Write statements (F3 + F4a, U2) with ``case_id`` and template."""
    df = log.filter(P.not_echo("line")) if exclude_echo else log
    return (df.filter(P.is_write("line", spaced=spaced, extra_markers=extra_markers))
            .withColumn("case_id", T.case_id("line"))
            .withColumn("normalized_query", T.normalize_query("line")))


def first_query_per_case(log: DataFrame, extra_markers=(), sort: bool = False) -> DataFrame:
    """A1 ``first_queries_by_case``: the first write statement of every case.

    ``min_by`` over ``seq`` is a partial aggregate, so a hot case is combined
    map-side instead of being sorted in one task (a null case is its own
    group, as in the windowed form).  Columns ``case_id, normalized_query, count``
    where ``count`` is 1 by construction, as in the reference."""
    first = (write_events(log, extra_markers=extra_markers)
             .groupBy("case_id")
             .agg(F.min_by("normalized_query", F.col("seq")).alias("normalized_query")))
    out = first.groupBy("case_id", "normalized_query").agg(F.count(F.lit(1)).alias("count"))
    return _sorted(out, sort, F.desc("count"), "case_id")


def first_query_frequency(log: DataFrame, extra_markers=(), sort: bool = False) -> DataFrame:
    """How many cases start with each template (the meaning the A1 header promises)."""
    first = (write_events(log, extra_markers=extra_markers)
             .groupBy("case_id")
             .agg(F.min_by("normalized_query", F.col("seq")).alias("normalized_query")))
    out = first.groupBy("normalized_query").agg(F.count(F.lit(1)).alias("count"))
    return _sorted(out, sort, F.desc("count"), "normalized_query")


def unique_cases(log: DataFrame) -> DataFrame:
    """A2 ``count_unique_cases``: distinct all-digit case ids over all lines (incl. "0")."""
    return (log.select(T.case_id("line").alias("case_id"))
            .filter(P.is_numeric("case_id")).distinct())


def table_names(log: DataFrame, pattern: str = T.TABLE_PATTERN) -> DataFrame:
    """A4 ``extract_table_names``: distinct table names of INSERT INTO / UPDATE
    lines (unspaced test, echo lines kept)."""
    return (log.filter(P.is_write("line", spaced=False))
            .select(T.table_name("line", pattern).alias("table_name"))
            .filter(P.found("table_name")).distinct())


def lines_by_table(log: DataFrame, tables: DataFrame, table_col: str = "table_name") -> DataFrame:
    """Every line paired with each known table whose name it contains
    (substring test, as the reference intends).

    Names are looked up by their rarest gram (``mentions``).  ``log`` is read twice, a
    share of its lines first, so a parsed log is best written before."""
    found = mentions(log.select("seq", "ts", "line"), "line", tables.select(F.col(table_col).alias("table_name")), "table_name")
    return found.select("seq", "ts", "table_name", "line")


def entity_lines(log: DataFrame, pattern: str = T.PLATE_PATTERN) -> DataFrame:
    """Read statements (F3 + F4e) that mention an entity (P6 + F8)."""
    return (log.filter(P.not_echo("line") & P.is_read("line"))
            .withColumn("entity", T.plate("line", pattern))
            .filter(P.found("entity")))


def entity_counts(log: DataFrame, pattern: str = T.PLATE_PATTERN, sort: bool = False) -> DataFrame:
    """A5 ``extract_arith_kykl_values``: read statements per entity (plate)."""
    out = entity_lines(log, pattern).groupBy("entity").agg(F.count(F.lit(1)).alias("count"))
    return _sorted(out, sort, F.desc("count"), "entity")


def only_valid(events: DataFrame, valid: DataFrame | None) -> DataFrame:
    """Events of valid templates.  The set is written first (a job while this is
    built): its size is then known, so Catalyst sends it to the events instead of
    dealing the events by a few hot templates."""
    if valid is None:
        return events
    return events.join(materialize(valid.select("normalized_query").distinct(), "valid"), "normalized_query", "left_semi")


def positioned_templates(log: DataFrame, valid: DataFrame | None = None, exclude_echo: bool = True, rule=None,
                         keep=("ts", "line")) -> DataFrame:
    """Statement events with a dense 0-based position after filtering
    (what ``zipWithIndex`` gives), computed per block plus block offsets.

    Valid templates are those of ``valid``, or those that ``rule`` = (max_count, max_share)
    finds in the log itself (``valid_events``)."""
    columns = list(dict.fromkeys(["seq", "block", *keep, "normalized_query"]))
    if rule is not None:
        ev = valid_events(log, *rule, exclude_echo=exclude_echo, keep=keep)
    else:
        ev = only_valid(statements(log, spaced=False, exclude_echo=exclude_echo).select(columns), valid)
    return with_position(ev.select(columns), order=["seq"], block="block", name="row_id")
