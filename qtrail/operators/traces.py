"""Per-entity traces and their directly-follows graph.

The primary results are *flat*: one row per event with its position in the
entity's trace.  Positions and successors are computed per entity; an entity
that holds more than a task's share of the log is cut in its order (``ordering``),
so one with a third of the log is spread over many tasks.  The nested per-entity lists of
the reference are offered as bounded chunks (``nest_traces``), never as one
unbounded ``collect_list`` per entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from .catalogue import entity_lines
from .ordering import dense_index, with_position, with_successor
from .skew import written

TRACE_ORDER = ["ts", "seq"]


def entity_traces(log: DataFrame, pattern: str = T.PLATE_PATTERN) -> DataFrame:
    """A6 ``group_queries_by_arith_kykl`` in flat form.

    Read statements with an entity, cut before `` WHERE `` (P5), duplicates of
    ``(timestamp, line)`` removed (first occurrence kept), ordered by
    ``(ts, seq)``.  Columns ``entity, query_count, pos, ts, seq, normalized_line``."""
    # entity and cut line follow from the line, so only (ts, line, seq) is shuffled
    lines = (entity_lines(log, pattern).groupBy("ts", "line").agg(F.min("seq").alias("seq"))
             .withColumn("entity", T.plate("line", pattern))
             .withColumn("normalized_line", T.before_where("line")))
    lines, heavy = written(lines.select("entity", "ts", "seq", "normalized_line"), ["entity"], "trace-lines")
    placed = with_position(lines, order=TRACE_ORDER, partition_by=["entity"], name="pos", total="query_count", heavy=heavy)
    return placed.select("entity", "query_count", "pos", "ts", "seq", "normalized_line")


def nest_traces(flat: DataFrame, key: str = "entity", chunk_size: int = 10_000,
                fields=("ts", "normalized_line"), names=("timestamp", "normalized_line")) -> DataFrame:
    """Nested view of a flat trace: ``(key, query_count, chunk, grouped_lines)``.

    ``grouped_lines`` is the ordered list of ``struct(timestamp, normalized_line)``
    for positions ``[chunk*chunk_size, (chunk+1)*chunk_size)``, so every list is
    bounded and a hot entity yields several rows instead of one huge one."""
    item = F.struct(F.col("pos"), *[F.col(f).alias(n) for f, n in zip(fields, names)])
    nested = (flat.withColumn("chunk", F.floor(F.col("pos") / chunk_size).cast("bigint"))
              .groupBy(key, "query_count", "chunk")
              .agg(F.sort_array(F.collect_list(item)).alias("_items")))
    return nested.select(key, "query_count", "chunk",
                         F.transform("_items", lambda x: F.struct(*[x[n].alias(n) for n in names]))
                         .alias("grouped_lines"))


def nest_records(flat: DataFrame, key_name: str = "ARXEISOD_ID", chunk_size: int = 10_000) -> DataFrame:
    """A7 in nested form: ``(key_name, chunk, grouped_lines ARRAY<STRING>)``, lines in
    file order, at most ``chunk_size`` in a row."""
    nested = (flat.withColumn("chunk", F.floor(F.col("pos") / chunk_size).cast("bigint"))
              .groupBy(F.col("record_id").alias(key_name), "chunk")
              .agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_items")))
    return nested.select(key_name, "chunk", F.transform("_items", lambda x: x["line"]).alias("grouped_lines"))


def record_groups(log: DataFrame, pattern: str = T.RECORD_ID_PATTERN) -> DataFrame:
    """A7 ``group_queries_by_id`` in flat form: every non-echo line whose record
    id is found (P7), duplicates kept, with its position in file order.

    Columns ``record_id, pos, seq, line``."""
    lines = (log.filter(P.not_echo("line"))
             .withColumn("record_id", T.record_id("line", pattern))
             .filter(P.found("record_id"))
             .select("record_id", "seq", "line"))
    lines, heavy = written(lines, ["record_id"], "record-lines")
    return with_position(lines, order=["seq"], partition_by=["record_id"], name="pos", heavy=heavy) \
        .select("record_id", "pos", "seq", "line")


def trace_events(flat: DataFrame) -> DataFrame:
    """G7 input: trace rows with the query text after the QUERY marker (P9);
    rows without the marker are dropped."""
    return (flat.withColumn("query_text", T.query_text("normalized_line"))
            .filter(F.col("query_text").isNotNull())
            .select("entity", "pos", "ts", "seq", "query_text"))


def trace_nodes(events: DataFrame) -> DataFrame:
    """One node per distinct ``(query_text, entity)`` numbered from 0 in
    encounter order (entity ascending, then first ``(ts, seq)``).

    Columns ``node_id, entity, query_text``."""
    first = (events.groupBy("entity", "query_text")
             .agg(F.min(F.struct("ts", "seq")).alias("_first"))
             .select("entity", "query_text", F.col("_first.ts").alias("_fts"), F.col("_first.seq").alias("_fseq")))
    return dense_index(first, ["entity", "_fts", "_fseq"], name="node_id") \
        .select("node_id", "entity", "query_text")


def trace_graph(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """G8 ``build_query_graph``: directly-follows edges inside each entity.

    Edge label = time of day of the successor event; a repeated edge keeps the
    label of its last occurrence (A12).  Columns ``start_node, end_node, label, count``."""
    ev = events.select("entity", "ts", "seq", "query_text",
                       F.col("ts").alias("_nts"), F.col("seq").alias("_nseq"))
    nxt = with_successor(ev, ["query_text", "_nts", "_nseq"], order=TRACE_ORDER,
                         partition_by=["entity"], prefix="next")
    # one row per edge before the node ids are joined: no event meets a hot key
    edges = (nxt.filter(F.col("nextquery_text").isNotNull()).groupBy("entity", "query_text", "nextquery_text")
             .agg(F.max_by(T.time_of_day(F.col("next_nts")), F.struct("next_nts", "next_nseq")).alias("label"),
                  F.count(F.lit(1)).alias("count")))
    start = nodes.select("entity", "query_text", F.col("node_id").alias("start_node"))
    end = nodes.select("entity", F.col("query_text").alias("nextquery_text"), F.col("node_id").alias("end_node"))
    return (edges.join(start, ["entity", "query_text"]).join(end, ["entity", "nextquery_text"])
            .select("start_node", "end_node", "label", "count"))
