"""

Every query reads the driver tables under ``sf_dir`` (the audit log is
rendered from ``events`` line by line by Spark, see ``qtrail.sources.rendered``)
and runs over the whole table.  Parameters are fixed per query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qtrail.operators import catalogue as C
from qtrail.operators import graph as G
from qtrail.operators import pairs as X
from qtrail.operators import structure as S
from qtrail.operators import traces as TR
from qtrail.operators.ordering import with_position
from qtrail.sources import auditlog as A
from qtrail.session import materialize
from qtrail.sources import rendered as R

try:  # the training-data operators and their pipeline are an optional part
    import corpus_pipeline as _pipeline
    from qtrail.llm import queries as _llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "qtrail.llm"):
        raise  # the part is there, something that it needs is not
    _pipeline = _llm = None

FLAGSHIP_DIR = "/root/testdata/sf0.001"

# Parameters (FIXTURES.md): shares of the log, so that they mean the same at every
# size - templates rarer than 5 %, pairs above 0.1 % of the events - and a low chain
# minimum so that two-edge chains exist.
MAX_SHARE = 0.05
PAIR_SHARE = 0.001
CHAIN_MIN = 0.005
CHAIN_LENGTH = 3


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rendered_log(spark, sf_dir)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: template catalogue (A3) of the log rendered from sf0.001 events."""
    return q_template_counts(spark, FLAGSHIP_DIR)


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------
def q_scan_events(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.select(F.col("seq").alias("event_id"), "ts", F.col("line"))


def q_template_counts(spark, sf_dir):
    return C.template_counts(_log(spark, sf_dir))


def q_first_query_per_case(spark, sf_dir):
    return C.first_query_per_case(_log(spark, sf_dir))


def q_first_query_frequency(spark, sf_dir):
    return C.first_query_frequency(_log(spark, sf_dir))


def q_unique_cases(spark, sf_dir):
    return C.unique_cases(_log(spark, sf_dir))


def q_table_names(spark, sf_dir):
    return C.table_names(_log(spark, sf_dir))


def q_lines_by_table(spark, sf_dir):
    log = materialize(_log(spark, sf_dir).select("seq", "ts", "line"), "log")  # read three times
    return (C.lines_by_table(log, C.table_names(log))
            .select(F.col("seq").alias("event_id"), "table_name"))


def q_entity_counts(spark, sf_dir):
    return C.entity_counts(_log(spark, sf_dir), R.RENDERED_PLATE_PATTERN)


def _valid(log):
    return C.valid_templates(log, None, MAX_SHARE)


def q_valid_templates(spark, sf_dir):
    return _valid(_log(spark, sf_dir))


def q_positioned_templates(spark, sf_dir):
    log = _log(spark, sf_dir)
    return (C.positioned_templates(log, rule=(None, MAX_SHARE), keep=())
            .select(F.col("seq").alias("event_id"), "normalized_query", "row_id"))


def q_consecutive_pairs(spark, sf_dir):
    log = _log(spark, sf_dir)
    return X.consecutive_pairs(log, None, 0, min_share=PAIR_SHARE, rule=(None, MAX_SHARE))


def q_pair_confidence(spark, sf_dir):
    log = _log(spark, sf_dir)
    return X.pair_confidence(log, None, 0, min_share=PAIR_SHARE, rule=(None, MAX_SHARE))


def q_template_confidence(spark, sf_dir):
    """X2 over every template (no ceiling): the edge table of the query graph."""
    return X.pair_confidence(_log(spark, sf_dir), None, 0, min_share=PAIR_SHARE)


def q_case_pairs(spark, sf_dir):
    """X2 per case (user) over all templates of the rendered log."""
    return X.pair_confidence(_log(spark, sf_dir), None, 0, partition_by=["case_id"])


def q_event_type_pairs(spark, sf_dir):
    """X2 on the raw events table: activity = event_type, one global sequence."""
    ev = R.load_table(spark, sf_dir, "events")
    return X.sequence_confidence(ev, None, "event_type", ["event_id"], F.shiftright("event_id", 14))


def q_order_priority_pairs(spark, sf_dir):
    """X2 on orders: case = customer, activity = priority, order = (date, key)."""
    orders = R.load_table(spark, sf_dir, "orders")
    return X.sequence_confidence(orders, "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"])


def q_entity_traces(spark, sf_dir):
    return (TR.entity_traces(_log(spark, sf_dir), R.RENDERED_PLATE_PATTERN)
            .select("entity", "query_count", "pos", "ts", F.col("seq").alias("event_id"), "normalized_line"))


def q_record_groups(spark, sf_dir):
    return (TR.record_groups(_log(spark, sf_dir), R.RENDERED_RECORD_ID_PATTERN)
            .select("record_id", "pos", F.col("seq").alias("event_id"), "line"))


def _trace_events(spark, sf_dir):
    # used twice (node numbering, then edges): computed once
    return materialize(TR.trace_events(TR.entity_traces(_log(spark, sf_dir), R.RENDERED_PLATE_PATTERN)))


def q_trace_nodes(spark, sf_dir):
    return TR.trace_nodes(_trace_events(spark, sf_dir))


def q_trace_graph(spark, sf_dir):
    ev = _trace_events(spark, sf_dir)
    return TR.trace_graph(ev, TR.trace_nodes(ev))


def q_order_trace_graph(spark, sf_dir):
    """G7/G8 on orders: per-customer traces of order priorities, ordered by
    (date, order key); several node kinds per entity, so real edges."""
    o = R.load_table(spark, sf_dir, "orders")
    ev = materialize(o.select(F.col("o_custkey").cast("string").alias("entity"),
                              F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
                              F.col("o_orderpriority").alias("query_text"))
                     .dropna(subset=["ts", "seq", "query_text"])  # no place or no text: no event
                     .withColumn("entity", F.coalesce("entity", F.lit("(none)"))))
    return TR.trace_graph(ev, TR.trace_nodes(ev))


def _graph_inputs(spark, sf_dir):
    # the edge table feeds legend, edges, chains, chain graph and components:
    # mined once from the log, then every graph step reads the materialised copy
    conf = _confidence(spark, sf_dir)
    leg = G.legend(conf)
    return leg, materialize(G.edges(conf, leg))


def _confidence(spark, sf_dir):
    return materialize(X.pair_confidence(_log(spark, sf_dir), None, 0, min_share=PAIR_SHARE))


def q_legend(spark, sf_dir):
    return G.legend(_confidence(spark, sf_dir))


def q_statement_kind(spark, sf_dir):
    return G.vertices(q_legend(spark, sf_dir))


def q_edges(spark, sf_dir):
    return _graph_inputs(spark, sf_dir)[1]


def _chains_out(ch):
    return ch.select(F.array_join("path", " -> ").alias("chain"), F.col("length").cast("bigint").alias("length"),
                     "confidence")


def q_chains_simple(spark, sf_dir):
    _, e = _graph_inputs(spark, sf_dir)
    return _chains_out(G.chains(e, CHAIN_MIN, CHAIN_LENGTH, allow_revisit=False, materialized=True))


def q_chains_revisit(spark, sf_dir):
    _, e = _graph_inputs(spark, sf_dir)
    return _chains_out(G.chains(e, CHAIN_MIN, CHAIN_LENGTH, allow_revisit=True, materialized=True))


def q_chain_graph(spark, sf_dir):
    _, e = _graph_inputs(spark, sf_dir)
    return G.chain_graph(e, CHAIN_MIN).drop("label")  # ties of the rounding differ between engines


def q_components(spark, sf_dir):
    leg, e = _graph_inputs(spark, sf_dir)
    return G.query_components(G.chain_graph(e, CHAIN_MIN), leg)


def q_supply_components(spark, sf_dir):
    """G6 at data scale: components of the part–supplier graph of lineitem
    (part p → vertex 2p, supplier s → vertex 2s+1)."""
    li = R.load_table(spark, sf_dir, "lineitem")
    edges = li.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return G.connected_components(edges, "src", "dst")


# Statement shapes and their structure; each event picks one by its id and names its
# tables (``#``) by its user, so the expected values of ``structure_shapes`` follow from
# the shape by the same naming.
SHAPES = [
    # (statement, tables, columns, functions, conditions)
    ("SELECT MAX(A)-MIN(B) FROM T# WHERE A = ?", "T#", "MAX(A)-MIN(B)", "", "A = ?"),
    ("SELECT UPPER(A) || LOWER(B), COUNT(C) FROM T#", "T#", "UPPER(A) || LOWER(B),COUNT(C)", "COUNT(C)", None),
    ("SELECT NVL(MAX(A),MIN(B)) FROM T3 X#", "X#", "NVL(MAX(A),MIN(B))", "NVL(MAX(A),MIN(B))", None),
    ("SELECT A FROM T as V# WHERE V#.A = ?", "V#", "A", "", "V#.A = ?"),
    ('SELECT A FROM "My Table" X#, "Other #" WHERE A = ?', "X#,Other #", "A", "", "A = ?"),
    ("SELECT A FROM DB.T#, S.U W", "T#,W", "A", "", None),
    ("SELECT DISTINCT A, B FROM T#", "T#", "A,B", "", None),
    ("select all A from T# where A = ? or B = ?", "T#", "A", "", "A = ? | B = ?"),
    ("SELECT * FROM T# WHERE A = ?", "T#", "", "", "A = ?"),
    ("SELECT A FROM T# WHERE CASE WHEN A = ? AND B = ? THEN ? ELSE ? END = ? AND C = ?", "T#", "A", "",
     "CASE WHEN A = ? AND B = ? THEN ? ELSE ? END = ? | C = ?"),
    ("SELECT A FROM T# WHERE A BETWEEN ? AND ? AND (B = ? OR C = ?)", "T#", "A", "", "A BETWEEN ? AND ? | (B = ? OR C = ?)"),
]


def q_structure_shapes(spark, sf_dir):
    """Q3, Q5, Q6, Q7 on log lines of varying names, one for each event: the lines are read like a
    log's, the structure of every distinct statement is walked once."""
    events = R.load_table(spark, sf_dir, "events")
    texts = F.array(*[F.lit(shape[0]) for shape in SHAPES])
    name = F.coalesce("user_id", F.lit(0)).cast("string")
    statement = F.replace(F.get(texts, (F.col("event_id") % len(SHAPES)).cast("int")), F.lit("#"), name)
    line = F.concat(F.lit("["), F.date_format("ts", R.LINE_PREFIX_TS), F.lit("] 1 user QUERY      : "), statement)
    raw = events.select(F.col("event_id").alias("seq"), F.lit(0).alias("block"), line.alias("value"))
    lines = A.statement_lines(raw, role=R.ROLE).select(F.trim("line").alias("statement"))
    counts = lines.groupBy("statement").count()
    walked = counts.repartition(16).select("statement", "count", S.clause_items(F.col("statement")).alias("_p"))  # CPU-bound: spread
    done = walked.select("statement", "count", F.inline(F.array(S.structure_of("_p"))))
    return done.select(
        "statement", "count", F.array_join("tables", ",").alias("tables"), F.array_join("columns", ",").alias("columns"),
        F.array_join(F.transform("functions", lambda f: F.concat(f["function"], F.lit("("), f["column"], F.lit(")"))), ",")
        .alias("functions"), F.array_join(F.transform("where", lambda w: w["condition"]), " | ").alias("conditions"))


def _shapes_sql() -> str:
    def text(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, " + ", ".join(map(text, shape)) + ")" for i, shape in enumerate(SHAPES))
    named = ", ".join(f"replace({c}, '#', name) AS {c}" for c in ("statement", "tables", "columns", "functions", "conditions"))
    return (f"SELECT statement, count(*) AS count, tables, columns, functions, conditions FROM (SELECT {named} FROM "
            f"(SELECT event_id, CAST(coalesce(user_id, 0) AS VARCHAR) AS name FROM events WHERE ts IS NOT NULL) "
            f"JOIN (VALUES {rows}) v(i, statement, tables, columns, functions, conditions) ON event_id % {len(SHAPES)} = i) GROUP BY ALL")


SPLIT_BYTES = 64 * 1024  # so that files of the small tables are read by several tasks, too
GREEK_ROLE = "Ελεγκτης"


def _log_files(spark, sf_dir):
    """The rendered log as windows-1253 files, one folder for each day, the role in Greek."""
    from qtrail.session import scratch_dir
    from qtrail.sinks import files as K
    folder = scratch_dir(spark, "log-files")
    raw = R.rendered_raw(spark, sf_dir)
    K.write_log(raw.select("seq", F.substring("value", 8, 4).alias("year"), F.substring("value", 5, 2).alias("month"),
                           F.replace("value", F.lit(f" {R.ROLE} "), F.lit(f" {GREEK_ROLE} ")).alias("value"))
                .select("seq", F.concat_ws("-", "year", "month").alias("month"), "value"), folder, "month")
    return folder


def q_scan_log_files(spark, sf_dir):
    """S1 on files: written in windows-1253, read back by splits, in the order of file and first byte."""
    log = A.read_audit_log(spark, _log_files(spark, sf_dir), split_bytes=SPLIT_BYTES)
    return with_position(log, order=["seq"], block="block", name="pos").select("pos", "ts", "line")


def q_scan_statement_files(spark, sf_dir):
    """S2 on files: the statement lines of one role."""
    lines = A.read_statement_lines(spark, _log_files(spark, sf_dir), role=GREEK_ROLE, split_bytes=SPLIT_BYTES)
    return with_position(lines, order=["seq"], block="block", name="pos").select("pos", "line")


def q_trace_array_files(spark, sf_dir):
    """K3 and S4 in the reference's layout: pretty JSON arrays, each read by several tasks."""
    from qtrail.session import scratch_dir
    from qtrail.sinks import files as K
    from qtrail.sources import tables as TB
    folder = scratch_dir(spark, "trace-arrays")
    flat = TR.entity_traces(_log(spark, sf_dir), R.RENDERED_PLATE_PATTERN)
    K.write_json_arrays(TR.nest_traces(flat, chunk_size=8), folder, ["entity", "chunk"], rows_per_file=20_000)
    back = TB.flatten_traces(TB.read_trace_json(spark, folder, array=True, split_bytes=SPLIT_BYTES))
    return back.select("entity", "pos", "ts", "normalized_line")


def q_file_contents(spark, sf_dir):
    """K1-K5 and O1, O2, O4 with P13: every output written, read back, and compared by content and place."""
    from qtrail.session import scratch_dir
    from qtrail.sinks import files as K
    from qtrail.sources import tables as TB
    log = materialize(_log(spark, sf_dir), "log")
    folder = scratch_dir(spark, "files")
    conf = materialize(X.pair_confidence(log, None, 0, min_share=PAIR_SHARE))
    leg = G.legend(conf)
    edges = materialize(G.edges(conf, leg))
    kept = G.chain_graph(edges, CHAIN_MIN)
    K.write_csv(conf.orderBy(F.desc("confidence"), "normalized_query", "next_query"), f"{folder}/edges")
    K.write_csv(C.template_counts(log, sort=True), f"{folder}/templates", single_file=True)
    K.write_csv(C.first_query_per_case(log, sort=True), f"{folder}/first")
    K.write_legend(leg, f"{folder}/legend")
    K.write_csv(kept.select("start_id", "end_id", "label"), f"{folder}/labels")
    K.write_csv(_chains_out(G.chains(edges, CHAIN_MIN, CHAIN_LENGTH, sort=True, materialized=True)).drop("confidence"), f"{folder}/chains")
    K.write_components(G.query_components(kept, leg), f"{folder}/components", chunk_size=7)
    K.write_json(TR.nest_records(TR.record_groups(log, R.RENDERED_RECORD_ID_PATTERN), chunk_size=2), f"{folder}/records")

    def rows(name, schema, key, content, ordered=True):
        back = TB.read_rows_in_order(spark, f"{folder}/{name}", schema, SPLIT_BYTES)
        return back.select(F.lit(name).alias("file"), F.col("pos") if ordered else F.lit(0).cast("bigint").alias("pos"),
                           F.concat_ws(" -> ", *key).alias("key"), F.concat_ws("|", *content).alias("content"))

    parts = spark.read.json(f"{folder}/components").select("component_id", "chunk", F.posexplode("queries").alias("i", "query"))
    records = spark.read.json(f"{folder}/records").select("ARXEISOD_ID", "chunk", F.posexplode("grouped_lines").alias("i", "line"))
    return (rows("edges", "normalized_query string, next_query string, count bigint, total_count bigint, confidence double",
                 ["normalized_query", "next_query"], ["count", "total_count"])
            .unionByName(rows("templates", "normalized_query string, count bigint", ["normalized_query"], ["count"]))
            .unionByName(rows("first", "case_id string, normalized_query string, count bigint", ["case_id"], ["normalized_query", "count"]))
            .unionByName(rows("legend", "Query string, ID string", ["Query"], ["ID"], ordered=False))
            .unionByName(rows("labels", "start_id string, end_id string, label string", ["start_id", "end_id"], ["label"], ordered=False))
            .unionByName(rows("chains", "chain string, length bigint", ["chain"], ["length"]))
            .unionByName(parts.select(F.lit("components").alias("file"), (F.col("chunk") * 7 + F.col("i")).alias("pos"),
                                      F.col("component_id").cast("string").alias("key"), F.col("query").alias("content")))
            .unionByName(records.select(F.lit("records").alias("file"), (F.col("chunk") * 2 + F.col("i")).alias("pos"),
                                        F.col("ARXEISOD_ID").alias("key"), F.col("line").alias("content"))))


def q_marked_first_query(spark, sf_dir):
    """A1 with a further marker, so that reads count as a case's first statement as well."""
    return C.first_query_per_case(_log(spark, sf_dir), extra_markers=("QUERY",))


def q_catalogue_strings(spark, sf_dir):
    """The statement catalogue with its nested parts as JSON text."""
    return S.catalogue_strings(S.statement_catalogue(A.statement_lines(R.rendered_raw(spark, sf_dir), role=R.ROLE)))


def q_file_round_trip(spark, sf_dir):
    """Edges through CSV, nested traces and record groups
    through JSON, read back; a digest per table."""
    from qtrail.session import scratch_dir
    from qtrail.sinks import files as K
    from qtrail.sources import tables as TB
    log = materialize(_log(spark, sf_dir), "log")
    folder = scratch_dir(spark, "files")
    K.write_csv(X.pair_confidence(log, None, 0, min_share=PAIR_SHARE, sort=True), f"{folder}/edges")
    K.write_json(TR.nest_traces(TR.entity_traces(log, R.RENDERED_PLATE_PATTERN), chunk_size=2), f"{folder}/traces")
    K.write_json(TR.nest_records(TR.record_groups(log, R.RENDERED_RECORD_ID_PATTERN), chunk_size=2), f"{folder}/records")
    edges = TB.read_edge_csv(spark, f"{folder}/edges")
    traces = TB.flatten_traces(TB.read_trace_json(spark, f"{folder}/traces"))
    records = spark.read.json(f"{folder}/records").select("ARXEISOD_ID", F.explode("grouped_lines").alias("line"))
    return (edges.select(F.lit("edges").alias("file"), F.col("normalized_query").alias("key"), F.col("count"))
            .unionByName(traces.groupBy("entity").agg(F.count("ts").alias("count"))
                         .select(F.lit("traces").alias("file"), F.col("entity").alias("key"), "count"))
            .unionByName(records.groupBy("ARXEISOD_ID").agg(F.count("line").alias("count"))
                         .select(F.lit("records").alias("file"), F.col("ARXEISOD_ID").alias("key"), "count")))


def q_statement_catalogue(spark, sf_dir):
    stmts = A.statement_lines(R.rendered_raw(spark, sf_dir), role=R.ROLE)
    cat = S.statement_catalogue(stmts)
    return cat.select(
        "type",
        F.array_join("tables", ",").alias("tables"),
        F.array_join("columns", ",").alias("columns"),
        F.array_join(F.transform("functions", lambda f: F.concat(f["function"], F.lit("("), f["column"], F.lit(")"))),
                     ",").alias("functions"),
        F.array_join(F.transform("where", lambda w: w["condition"]), " | ").alias("conditions"),
        F.array_join(F.transform("where", lambda w: w["operator"]), ",").alias("operators"),
        F.array_join(F.transform("from_tokens", lambda t: F.concat(t["kind"], F.lit(":"), t["value"])), " | ")
        .alias("from_tokens")).distinct()


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_events": q_scan_events,
    "template_counts": q_template_counts,
    "first_query_per_case": q_first_query_per_case,
    "first_query_frequency": q_first_query_frequency,
    "unique_cases": q_unique_cases,
    "table_names": q_table_names,
    "lines_by_table": q_lines_by_table,
    "entity_counts": q_entity_counts,
    "valid_templates": q_valid_templates,
    "positioned_templates": q_positioned_templates,
    "consecutive_pairs": q_consecutive_pairs,
    "pair_confidence": q_pair_confidence,
    "template_confidence": q_template_confidence,
    "case_pairs": q_case_pairs,
    "event_type_pairs": q_event_type_pairs,
    "order_priority_pairs": q_order_priority_pairs,
    "entity_traces": q_entity_traces,
    "record_groups": q_record_groups,
    "trace_nodes": q_trace_nodes,
    "trace_graph": q_trace_graph,
    "order_trace_graph": q_order_trace_graph,
    "legend": q_legend,
    "statement_kind": q_statement_kind,
    "edges": q_edges,
    "chains_simple": q_chains_simple,
    "chains_revisit": q_chains_revisit,
    "chain_graph": q_chain_graph,
    "components": q_components,
    "supply_components": q_supply_components,
    "statement_catalogue": q_statement_catalogue,
    "structure_shapes": q_structure_shapes,
    "file_round_trip": q_file_round_trip,
    "scan_log_files": q_scan_log_files,
    "scan_statement_files": q_scan_statement_files,
    "trace_array_files": q_trace_array_files,
    "file_contents": q_file_contents,
    "marked_first_query": q_marked_first_query,
    "catalogue_strings": q_catalogue_strings,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    extra = {} if _llm is None else {**_llm.queries(), "pipeline": _pipeline.run}
    return {**_QUERIES, **extra}


# ---------------------------------------------------------------------------
# DuckDB oracle: the same log rendered in SQL, then plain SQL per query.
# ---------------------------------------------------------------------------
_LOG_CTE = """
shaped AS (
  SELECT event_id, ts, event_type, coalesce(user_id, 0) AS user_id,
    CASE WHEN (event_id >> 12) & 1 = 0 THEN 'A' ELSE 'B' END
      || CAST(1000003 // ((event_id % 1000003) * 7919 % 1000003 + 1) AS VARCHAR) AS shape
  FROM events
),
raw AS (
  SELECT event_id * 2 + copy AS seq, date_trunc('second', ts) AS ts, user_id,
    '[' || strftime(ts, '%d/%m/%Y %H:%M:%S') || '] ' || CAST(user_id AS VARCHAR) || ' user ' ||
    CASE event_type
      WHEN 'view' THEN printf('QUERY      : SELECT ID,NAME FROM ITEMS%s WHERE PLATE=''ABC%07d'' AND ID = %d', shape, user_id, event_id)
      WHEN 'click' THEN printf('QUERY      : SELECT COUNT(ID) FROM CLICKS%s C LEFT OUTER JOIN ITEMS%s I ON (C.ITEM_ID=I.ID) WHERE (C.USER_ID = %d) AND (C.FLAG = ''T'')', shape, shape, user_id)
      WHEN 'signup' THEN printf('TRANSACTION: INSERT INTO USERS%s (ID,NAME) VALUES (%d,''u:x'')', shape, user_id)
      WHEN 'purchase' THEN printf('TRANSACTION: UPDATE ORDERS%s SET TOTAL = 1.5 WHERE ORDERS.ID = %d', shape, event_id // 20)
      WHEN 'error' THEN printf('INPUT      : QUERY ignored %d', event_id)
      ELSE printf('INPUT      : OTHER %d', event_id)
    END || CASE WHEN event_id % 11 = 0 THEN '  ' ELSE '' END AS value
  FROM (SELECT *, unnest(CASE WHEN event_type = 'view' AND event_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM shaped)
),
log AS (
  SELECT seq, ts, trim(value) AS line FROM raw
  WHERE value LIKE '[%' AND ts IS NOT NULL AND trim(value) <> ''
)"""


def _body(line: str, spaced: bool) -> str:
    sp = " " if spaced else ""

    def lits(kw: str) -> str:
        return f"regexp_replace(replace(string_split({line}, '{kw}')[2], ':', ''), '''[^\\n]*?''', '?', 'g')"

    return (f"CASE WHEN contains({line}, 'QUERY{sp}') THEN {lits('QUERY')} "
            f"WHEN contains({line}, 'INSERT INTO{sp}') THEN 'INSERT INTO ' || {lits('INSERT INTO')} "
            f"ELSE 'UPDATE ' || {lits('UPDATE')} END")


def _norm(line: str = "line") -> str:
    body = _body(line, True)
    return (f"coalesce(trim(regexp_replace(regexp_replace({body}, '\\b\\d+(\\.\\d+)?\\b', '?', 'g'), "
            f"'\\s+', ' ', 'g')), '')")


def _case(line: str = "line") -> str:
    return f"string_split({line}, ' ')[3]"


_STMT_UNSPACED = "(contains(line, 'QUERY') OR contains(line, 'INSERT INTO') OR contains(line, 'UPDATE'))"
_STMT_SPACED = "(contains(line, ' QUERY ') OR contains(line, ' INSERT INTO ') OR contains(line, ' UPDATE '))"
_WRITE_SPACED = "(contains(line, ' INSERT INTO ') OR contains(line, ' UPDATE '))"
_WRITE_UNSPACED = "(contains(line, 'INSERT INTO') OR contains(line, 'UPDATE'))"
_NOT_ECHO = "NOT contains(line, 'INPUT')"

_TEMPLATE_COUNTS = f"""
counts AS (
  SELECT normalized_query, count(*) AS count FROM (
    SELECT {_norm()} AS normalized_query FROM log WHERE {_NOT_ECHO} AND {_STMT_SPACED}
  ) WHERE normalized_query <> '' GROUP BY normalized_query
),
valid AS (SELECT normalized_query FROM counts WHERE count < CAST({MAX_SHARE} AS DOUBLE) * (SELECT sum(count) FROM counts))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join([_LOG_CTE, *ctes]) + "\n"


def _pairs_sql(valid: bool, exclude_echo: bool, case: bool) -> str:
    echo = f"AND {_NOT_ECHO}" if exclude_echo else ""
    vfilter = "WHERE normalized_query IN (SELECT normalized_query FROM valid)" if valid else ""
    return f"""
ev AS (
  SELECT * FROM (SELECT seq, {_case()} AS case_id, {_norm()} AS normalized_query FROM log WHERE {_STMT_UNSPACED} {echo})
  {vfilter}
),
nx AS (
  SELECT normalized_query, lead(normalized_query) OVER (PARTITION BY {'case_id' if case else '1'} ORDER BY seq) AS next_query FROM ev
),
totals AS (SELECT normalized_query, count(*) AS total_count FROM nx GROUP BY normalized_query),
pairs AS (SELECT normalized_query, next_query, count(*) AS count FROM nx WHERE next_query IS NOT NULL GROUP BY ALL)"""


def _frequent(share: float | None) -> str:
    return "true" if share is None else f"count > CAST({share} AS DOUBLE) * (SELECT count(*) FROM nx)"


def _conf_select(share: float | None) -> str:
    return f"""SELECT p.normalized_query, p.next_query, p.count, t.total_count,
       p.count / t.total_count AS confidence
FROM pairs p JOIN totals t USING (normalized_query) WHERE {_frequent(share)}"""


def _seq_conf_sql(table: str, case: str | None, query: str, order: str) -> str:
    part = f"PARTITION BY {case}" if case else ""
    return f"""WITH nx AS (
  SELECT {query} AS normalized_query, lead({query}) OVER ({part} ORDER BY {order}) AS next_query FROM {table}
),
totals AS (SELECT normalized_query, count(*) AS total_count FROM nx GROUP BY normalized_query),
pairs AS (SELECT normalized_query, next_query, count(*) AS count FROM nx WHERE next_query IS NOT NULL GROUP BY ALL)
{_conf_select(None)}"""


_TRACES = f"""
el AS (
  SELECT seq, ts, line, regexp_extract(line, '([A-Z]{{3}}\\d{{7,}})', 1) AS entity,
         string_split(line, ' WHERE ')[1] AS normalized_line
  FROM log WHERE {_NOT_ECHO} AND contains(line, ' QUERY ')
),
tr AS (
  SELECT entity, ts, normalized_line, min(seq) AS seq FROM el WHERE entity <> ''
  GROUP BY entity, ts, line, normalized_line
),
te AS (
  SELECT entity, ts, seq, string_split(normalized_line, 'QUERY      : ')[2] AS query_text FROM tr
  WHERE contains(normalized_line, 'QUERY      : ')
),
nodes AS (
  SELECT row_number() OVER (ORDER BY entity, ts, seq) - 1 AS node_id, entity, query_text FROM (
    SELECT entity, query_text, ts, seq,
           row_number() OVER (PARTITION BY entity, query_text ORDER BY ts, seq) AS k FROM te
  ) WHERE k = 1
)"""

_GRAPH = _pairs_sql(False, True, False) + f""",
conf AS ({_conf_select(PAIR_SHARE)}),
leg AS (
  SELECT query, 'Q' || CAST(ordinal AS VARCHAR) AS id, ordinal FROM (
    SELECT query, row_number() OVER (ORDER BY query) AS ordinal FROM (
      SELECT normalized_query AS query FROM conf UNION SELECT next_query FROM conf))
),
edg AS (
  SELECT s.id AS start_id, e.id AS end_id, s.ordinal AS start_ordinal, e.ordinal AS end_ordinal,
         c.confidence, c.count, c.total_count
  FROM conf c JOIN leg s ON c.normalized_query = s.query JOIN leg e ON c.next_query = e.query
)"""


def _paths_cte(revisit: bool) -> str:
    loop = "" if revisit else "AND start_id <> end_id"
    seen = "" if revisit else "AND NOT list_contains(p.path, e.end_id)"
    return f"""
paths AS (
  SELECT [start_id, end_id] AS path, end_id AS last, confidence, 1 AS length FROM edg
  WHERE confidence >= {CHAIN_MIN} {loop}
  UNION ALL
  SELECT list_append(p.path, e.end_id), e.end_id, p.confidence * e.confidence, p.length + 1
  FROM paths p JOIN edg e ON p.last = e.start_id
  WHERE p.length < {CHAIN_LENGTH} AND p.confidence * e.confidence >= {CHAIN_MIN} {seen}
)"""


_CHAIN_GRAPH = """
steps AS (
  SELECT DISTINCT path[i] AS start_id, path[i + 1] AS end_id
  FROM (SELECT path, unnest(range(1, len(path))) AS i FROM paths)
),
cg AS (SELECT * FROM edg WHERE (start_id, end_id) IN (SELECT (start_id, end_id) FROM steps))"""

_COMPONENTS = """
und AS (SELECT start_ordinal AS a, end_ordinal AS b FROM cg UNION SELECT end_ordinal, start_ordinal FROM cg),
reach(v, w) AS (
  SELECT a, a FROM und
  UNION
  SELECT r.v, u.b FROM reach r JOIN und u ON r.w = u.a
),
comp AS (SELECT v, min(w) AS root FROM reach GROUP BY v)"""

_SUPPLY = """WITH RECURSIVE
und AS (
  SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem
  WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL
  UNION SELECT DISTINCT l_suppkey * 2 + 1, l_partkey * 2 FROM lineitem
  WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL
),
reach(v, w) AS (
  SELECT a, a FROM und
  UNION
  SELECT r.v, u.b FROM reach r JOIN und u ON r.w = u.a
)
SELECT v AS vertex, min(w) AS component FROM reach GROUP BY v"""


def _with_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([_LOG_CTE, *ctes]) + "\n"


_DML = "'SELECT','INSERT','UPDATE','DELETE'"
_CLAUSES = "'FROM','WHERE','SET','VALUES','INTO'"
_TAILS = "'GROUP','ORDER','HAVING','LIMIT','UNION','EXCEPT','INTERSECT','OFFSET','FETCH','RETURNING','FOR'"
_JOINS = "'JOIN','INNER','LEFT','RIGHT','FULL','OUTER','CROSS','NATURAL'"
_W = "PARTITION BY statement ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

_STRUCTURE = f"""
stmts AS (
  SELECT DISTINCT replace({_body('value', False)}, chr(10), ' ') AS statement FROM raw
  WHERE contains(value, 'user') AND starts_with(value, '[') AND {_STMT_UNSPACED.replace('line', 'value')}
),
tok AS (
  SELECT statement, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM (
    SELECT statement, regexp_extract_all(statement, '\\s*(?:[(),?]|\\w+(?:\\.\\w+)*|[^\\s\\w(),?]+)') AS ts FROM stmts)
),
t1 AS (
  SELECT statement, i, t, upper(trim(t)) AS u,
    coalesce(sum(CASE upper(trim(t)) WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER ({_W}), 0) AS d
  FROM tok
),
t2 AS (
  SELECT *, d = 0 AND (u IN ({_DML}) OR u IN ({_CLAUSES}) OR u IN ({_TAILS})) AS is_b,
    CASE WHEN u IN ({_TAILS}) THEN 'TAIL' ELSE u END AS bmap FROM t1
),
t3 AS (
  SELECT *, coalesce(last_value(CASE WHEN is_b THEN bmap END IGNORE NULLS) OVER ({_W}), '') AS base,
    coalesce(sum(CASE WHEN is_b THEN 1 ELSE 0 END) OVER ({_W}), 0) AS seg FROM t2
),
t4 AS (
  SELECT *, CASE WHEN base = 'FROM' THEN coalesce(last_value(
      CASE WHEN d = 0 AND u IN ('ON','USING') THEN 'ON' WHEN d = 0 AND u IN ({_JOINS}) THEN 'FROM' END IGNORE NULLS)
      OVER (PARTITION BY statement, seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'FROM')
      ELSE base END AS state
  FROM t3
),
t5 AS (
  SELECT *, coalesce(last_value(CASE WHEN d = 0 AND ((u = 'BETWEEN' AND state = 'WHERE') OR u = 'AND') THEN u END IGNORE NULLS)
      OVER ({_W}), '') = 'BETWEEN' AS btw,
    d = 0 AND state IN ('FROM','ON') AND u IN ({_JOINS}) AS is_join,
    d = 0 AND state = 'FROM' AND u IN ('ON','USING') AS is_on,
    d = 0 AND state IN ('SELECT','SET','FROM') AND u = ',' AS is_list
  FROM t4
),
t6 AS (
  SELECT *, d = 0 AND state = 'WHERE' AND u IN ('AND','OR') AND NOT (u = 'AND' AND btw) AS is_bool FROM t5
),
t7 AS (
  SELECT *, is_b OR is_list OR is_bool OR is_join OR is_on AS is_cut FROM t6
),
t8 AS (
  SELECT *, coalesce(sum(CASE WHEN is_cut THEN 1 ELSE 0 END) OVER ({_W}), 0) AS k,
    CASE WHEN is_join THEN i - row_number() OVER (PARTITION BY statement, is_join ORDER BY i) END AS run
  FROM t7
),
cuts AS (SELECT statement, k - 0 AS k, i AS epos, CASE WHEN is_list OR is_bool THEN u ELSE '' END AS sep,
           row_number() OVER (PARTITION BY statement ORDER BY i) - 1 AS kk FROM t8 WHERE is_cut),
members AS (
  SELECT statement, k, min(state) AS clause, trim(string_agg(t, '' ORDER BY i)) AS text FROM t8
  WHERE NOT is_cut GROUP BY statement, k
),
cur_items AS (
  SELECT m.statement, coalesce(c.epos, 1000000000) AS epos, 0 AS sub, m.clause, m.text, coalesce(c.sep, '') AS sep
  FROM members m LEFT JOIN cuts c ON c.statement = m.statement AND c.kk = m.k WHERE m.text <> ''
),
runs AS (SELECT statement, run, max(i) AS last_i, string_agg(u, ' ' ORDER BY i) AS kw FROM t8 WHERE is_join GROUP BY ALL),
kw_items AS (
  SELECT r.statement, coalesce(min(n.i), 1000000000) AS epos, 1 AS sub, 'KW' AS clause, r.kw AS text, '' AS sep
  FROM runs r LEFT JOIN t8 n ON n.statement = r.statement AND n.i = r.last_i + 1 GROUP BY r.statement, r.run, r.kw
),
on_items AS (SELECT statement, i AS epos, 2 AS sub, 'KW' AS clause, u AS text, '' AS sep FROM t8 WHERE is_on),
items AS (SELECT * FROM cur_items UNION ALL SELECT * FROM kw_items UNION ALL SELECT * FROM on_items),
kinds AS (SELECT statement, coalesce(min_by(u, i) FILTER (WHERE d = 0 AND u IN ({_DML})), '') AS type FROM t8 GROUP BY statement),
refs AS (
  SELECT statement, epos, sub, regexp_extract(text, '^(\\(.*\\)|\\S+)(?:\\s+(?:AS\\s+)?(\\w+))?$', 1) AS tbl,
    regexp_extract(text, '^(\\(.*\\)|\\S+)(?:\\s+(?:AS\\s+)?(\\w+))?$', 2) AS alias
  FROM items WHERE clause = 'FROM'
),
agg AS (
  SELECT s.statement, k.type,
    coalesce((SELECT string_agg(CASE WHEN alias <> '' THEN alias ELSE tbl END, ',' ORDER BY epos, sub) FROM refs r
              WHERE r.statement = s.statement), '') AS tables,
    coalesce((SELECT string_agg(text, ',' ORDER BY epos, sub) FROM items x WHERE x.statement = s.statement AND clause = 'SELECT'), '') AS columns,
    coalesce((SELECT string_agg(regexp_extract(text, '^(\\w+)\\s*\\((.*)\\)$', 1) || '(' ||
                                regexp_extract(text, '^(\\w+)\\s*\\((.*)\\)$', 2) || ')', ',' ORDER BY epos, sub)
              FROM items x WHERE x.statement = s.statement AND clause = 'SELECT'
                AND regexp_extract(text, '^(\\w+)\\s*\\((.*)\\)$', 1) <> ''), '') AS functions,
    (SELECT string_agg(trim(regexp_replace(regexp_replace(text, '\\b\\d+(\\.\\d+)?\\b', '?', 'g'), '\\s+', ' ', 'g')),
                       ' | ' ORDER BY epos, sub) FROM items x WHERE x.statement = s.statement AND clause = 'WHERE') AS conditions,
    (SELECT string_agg(sep, ',' ORDER BY epos, sub) FROM items x WHERE x.statement = s.statement AND clause = 'WHERE') AS operators,
    coalesce((SELECT string_agg(CASE WHEN clause = 'KW' THEN 'keyword' WHEN starts_with(trim(text), '(') THEN 'subquery'
                                ELSE 'table' END || ':' || text, ' | ' ORDER BY epos, sub)
              FROM items x WHERE x.statement = s.statement AND clause IN ('FROM', 'KW')), '') AS from_tokens
  FROM stmts s JOIN kinds k USING (statement)
)"""


_STRUCTURE_JSON = """
texts AS (
  SELECT s.statement, s.type, s.tables, s.columns,
    coalesce((SELECT to_json(list({'kind': CASE WHEN clause = 'KW' THEN 'keyword' WHEN starts_with(trim(text), '(') THEN 'subquery' ELSE 'table' END,
                                   'value': text} ORDER BY epos, sub))
              FROM items x WHERE x.statement = s.statement AND clause IN ('FROM', 'KW')), '[]')::VARCHAR AS from_tokens,
    coalesce((SELECT to_json(list({'condition': trim(regexp_replace(regexp_replace(text, '\\b\\d+(\\.\\d+)?\\b', '?', 'g'), '\\s+', ' ', 'g')),
                                   'operator': sep} ORDER BY epos, sub))
              FROM items x WHERE x.statement = s.statement AND clause = 'WHERE'), '[]')::VARCHAR AS "where",
    coalesce((SELECT to_json(list({'function': regexp_extract(text, '^(\\w+)\\s*\\((.*)\\)$', 1),
                                   'column': regexp_extract(text, '^(\\w+)\\s*\\((.*)\\)$', 2)} ORDER BY epos, sub))
              FROM items x WHERE x.statement = s.statement AND clause = 'SELECT'
                AND regexp_extract(text, '^(\\w+)\\s*\\((.*)\\)$', 1) <> ''), '[]')::VARCHAR AS columns_tokens
  FROM agg s
)"""


def oracle_sql() -> dict[str, str]:
    extra = {} if _llm is None else dict(_llm.oracle_sql())
    if _llm is not None and _pipeline.ORACLE_SQL:
        extra["pipeline"] = _pipeline.ORACLE_SQL
    return {**_core_sql(), **extra}


def _core_sql() -> dict[str, str]:
    return {
        "scan_events": _with() + "SELECT seq AS event_id, ts, line FROM log",
        "template_counts": _with(_TEMPLATE_COUNTS) + "SELECT normalized_query, count FROM counts",
        "first_query_per_case": _with() + f"""
SELECT case_id, normalized_query, count(*) AS count FROM (
  SELECT case_id, arg_min(normalized_query, seq) AS normalized_query FROM (
    SELECT seq, {_case()} AS case_id, {_norm()} AS normalized_query FROM log WHERE {_NOT_ECHO} AND {_WRITE_SPACED}
  ) GROUP BY case_id
) GROUP BY ALL""",
        "first_query_frequency": _with() + f"""
SELECT normalized_query, count(*) AS count FROM (
  SELECT case_id, arg_min(normalized_query, seq) AS normalized_query FROM (
    SELECT seq, {_case()} AS case_id, {_norm()} AS normalized_query FROM log WHERE {_NOT_ECHO} AND {_WRITE_SPACED}
  ) GROUP BY case_id
) GROUP BY ALL""",
        "unique_cases": _with() + f"""
SELECT DISTINCT case_id FROM (SELECT {_case()} AS case_id FROM log) WHERE regexp_full_match(case_id, '[0-9]+')""",
        "table_names": _with() + f"""
SELECT DISTINCT table_name FROM (
  SELECT regexp_extract(line, '(INSERT INTO|UPDATE)\\s+([a-zA-Z0-9_]+)', 2) AS table_name FROM log WHERE {_WRITE_UNSPACED}
) WHERE table_name <> ''""",
        "lines_by_table": _with(f"""
tabs AS (SELECT DISTINCT table_name FROM (
  SELECT regexp_extract(line, '(INSERT INTO|UPDATE)\\s+([a-zA-Z0-9_]+)', 2) AS table_name FROM log WHERE {_WRITE_UNSPACED}
) WHERE table_name <> '')""") + "SELECT seq AS event_id, table_name FROM log JOIN tabs ON contains(line, table_name)",
        "entity_counts": _with() + f"""
SELECT entity, count(*) AS count FROM (
  SELECT regexp_extract(line, '([A-Z]{{3}}\\d{{7,}})', 1) AS entity FROM log WHERE {_NOT_ECHO} AND contains(line, ' QUERY ')
) WHERE entity <> '' GROUP BY entity""",
        "valid_templates": _with(_TEMPLATE_COUNTS) + "SELECT normalized_query FROM valid",
        "positioned_templates": _with(_TEMPLATE_COUNTS) + f"""
SELECT seq AS event_id, normalized_query, row_number() OVER (ORDER BY seq) - 1 AS row_id FROM (
  SELECT seq, {_norm()} AS normalized_query FROM log WHERE {_NOT_ECHO} AND {_STMT_UNSPACED}
) WHERE normalized_query IN (SELECT normalized_query FROM valid)""",
        "consecutive_pairs": _with(_TEMPLATE_COUNTS, _pairs_sql(True, False, False))
        + f"SELECT normalized_query, next_query, count FROM pairs WHERE {_frequent(PAIR_SHARE)}",
        "pair_confidence": _with(_TEMPLATE_COUNTS, _pairs_sql(True, True, False)) + _conf_select(PAIR_SHARE),
        "template_confidence": _with(_pairs_sql(False, True, False)) + _conf_select(PAIR_SHARE),
        "case_pairs": _with(_pairs_sql(False, True, True)) + _conf_select(None),
        "event_type_pairs": _seq_conf_sql("events", None, "event_type", "event_id"),
        "order_priority_pairs": _seq_conf_sql("orders", "o_custkey", "o_orderpriority", "o_orderdate, o_orderkey"),
        "entity_traces": _with(_TRACES) + """
SELECT entity, count(*) OVER (PARTITION BY entity) AS query_count,
       row_number() OVER (PARTITION BY entity ORDER BY ts, seq) - 1 AS pos, ts, seq AS event_id, normalized_line
FROM tr""",
        "record_groups": _with() + f"""
SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY seq) - 1 AS pos, seq AS event_id, line FROM (
  SELECT seq, line, regexp_extract(line, 'WHERE. *?\\bORDERS\\.ID\\s*=\\s*(\\d+)', 1) AS record_id
  FROM log WHERE {_NOT_ECHO}
) WHERE record_id <> ''""",
        "trace_nodes": _with(_TRACES) + "SELECT node_id, entity, query_text FROM nodes",
        "trace_graph": _with(_TRACES) + """
, ev AS (SELECT te.entity, te.ts, te.seq, n.node_id FROM te JOIN nodes n USING (entity, query_text)),
nx AS (
  SELECT node_id AS start_node, lead(node_id) OVER w AS end_node, lead(ts) OVER w AS nts, lead(seq) OVER w AS nseq
  FROM ev WINDOW w AS (PARTITION BY entity ORDER BY ts, seq)
)
SELECT start_node, end_node, strftime(nts, '%H:%M:%S') AS label, count(*) OVER (PARTITION BY start_node, end_node) AS count
FROM nx WHERE end_node IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY start_node, end_node ORDER BY nts DESC, nseq DESC) = 1""",
        "order_trace_graph": """WITH te AS (
  SELECT coalesce(CAST(o_custkey AS VARCHAR), '(none)') AS entity, o_orderdate AS ts, o_orderkey AS seq,
         o_orderpriority AS query_text
  FROM orders
  WHERE o_orderdate IS NOT NULL AND o_orderkey IS NOT NULL AND o_orderpriority IS NOT NULL
),
nodes AS (
  SELECT row_number() OVER (ORDER BY entity, ts, seq) - 1 AS node_id, entity, query_text FROM (
    SELECT entity, query_text, ts, seq,
           row_number() OVER (PARTITION BY entity, query_text ORDER BY ts, seq) AS k FROM te
  ) WHERE k = 1
),
ev AS (SELECT te.entity, te.ts, te.seq, n.node_id FROM te JOIN nodes n USING (entity, query_text)),
nx AS (
  SELECT node_id AS start_node, lead(node_id) OVER w AS end_node, lead(ts) OVER w AS nts, lead(seq) OVER w AS nseq
  FROM ev WINDOW w AS (PARTITION BY entity ORDER BY ts, seq)
)
SELECT start_node, end_node, strftime(nts, '%H:%M:%S') AS label, count(*) OVER (PARTITION BY start_node, end_node) AS count
FROM nx WHERE end_node IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY start_node, end_node ORDER BY nts DESC, nseq DESC) = 1""",
        "legend": _with(_GRAPH) + "SELECT query, id, ordinal FROM leg",
        "statement_kind": _with(_GRAPH) + """
SELECT query, id, ordinal,
       CASE WHEN contains(query, 'SELECT') THEN 'read' WHEN contains(query, 'INSERT') THEN 'insert' ELSE 'write' END AS kind
FROM leg""",
        "edges": _with(_GRAPH) + "SELECT * FROM edg",
        "chains_simple": _with_rec(_GRAPH, _paths_cte(False))
        + "SELECT array_to_string(path, ' -> ') AS chain, CAST(length AS BIGINT) AS length, confidence FROM paths",
        "chains_revisit": _with_rec(_GRAPH, _paths_cte(True))
        + "SELECT array_to_string(path, ' -> ') AS chain, CAST(length AS BIGINT) AS length, confidence FROM paths",
        "chain_graph": _with_rec(_GRAPH, _paths_cte(False), _CHAIN_GRAPH) + "SELECT * FROM cg",
        "components": _with_rec(_GRAPH, _paths_cte(False), _CHAIN_GRAPH, _COMPONENTS) + """
SELECT dense_rank() OVER (ORDER BY c.root) AS component_id, l.query FROM comp c JOIN leg l ON l.ordinal = c.v""",
        "supply_components": _SUPPLY,
        "structure_shapes": _shapes_sql(),
        "file_round_trip": _with(_GRAPH, _TRACES) + """
SELECT 'edges' AS file, normalized_query AS key, count FROM conf
UNION ALL SELECT 'traces', entity, count(*) FROM tr GROUP BY entity
UNION ALL SELECT 'records', record_id, count(*) FROM (
  SELECT regexp_extract(line, 'WHERE. *?\\bORDERS\\.ID\\s*=\\s*(\\d+)', 1) AS record_id FROM log
  WHERE NOT contains(line, 'INPUT')) WHERE record_id <> '' GROUP BY record_id""",
        "scan_log_files": _with() + f"""SELECT row_number() OVER (ORDER BY seq) - 1 AS pos, ts,
       replace(line, ' user ', ' {GREEK_ROLE} ') AS line FROM log""",
        "scan_statement_files": _with() + f"""SELECT row_number() OVER (ORDER BY seq) - 1 AS pos, {_body('value', False)} AS line
FROM (SELECT seq, replace(value, ' user ', ' {GREEK_ROLE} ') AS value FROM raw)
WHERE starts_with(value, '[') AND {_STMT_UNSPACED.replace('line', 'value')}""",
        "trace_array_files": _with(_TRACES) + """
SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY ts, seq) - 1 AS pos, ts, normalized_line FROM tr""",
        "file_contents": _with_rec(_TEMPLATE_COUNTS, _GRAPH, _paths_cte(False), _CHAIN_GRAPH, _COMPONENTS) + f"""
SELECT 'edges' AS file, row_number() OVER (ORDER BY confidence DESC, normalized_query, next_query) - 1 AS pos,
       normalized_query || ' -> ' || next_query AS key, count || '|' || total_count AS content FROM conf
UNION ALL SELECT 'templates', row_number() OVER (ORDER BY count DESC, normalized_query) - 1, normalized_query, CAST(count AS VARCHAR) FROM counts
UNION ALL SELECT 'first', row_number() OVER (ORDER BY case_id) - 1, case_id, normalized_query || '|1' FROM (
  SELECT case_id, arg_min(normalized_query, seq) AS normalized_query FROM (
    SELECT seq, {_case()} AS case_id, {_norm()} AS normalized_query FROM log WHERE {_NOT_ECHO} AND {_WRITE_SPACED}) GROUP BY case_id)
UNION ALL SELECT 'legend', 0, query, id FROM leg
UNION ALL SELECT 'labels', 0, start_id || ' -> ' || end_id,
  printf('%d.%02d', (200 * count + total_count) // (2 * total_count) // 100, (200 * count + total_count) // (2 * total_count) % 100) FROM cg
UNION ALL SELECT 'chains', row_number() OVER (ORDER BY confidence DESC, path) - 1, array_to_string(path, ' -> '), CAST(length AS VARCHAR) FROM paths
UNION ALL SELECT 'components', row_number() OVER (PARTITION BY root ORDER BY query) - 1, CAST(dense_rank() OVER (ORDER BY root) AS VARCHAR), query
  FROM comp c JOIN leg l ON l.ordinal = c.v
UNION ALL SELECT 'records', row_number() OVER (PARTITION BY record_id ORDER BY seq) - 1, record_id, line FROM (
  SELECT seq, line, regexp_extract(line, 'WHERE. *?\\bORDERS\\.ID\\s*=\\s*(\\d+)', 1) AS record_id FROM log WHERE {_NOT_ECHO}) WHERE record_id <> ''""",
        "marked_first_query": _with() + f"""
SELECT case_id, arg_min(normalized_query, seq) AS normalized_query, CAST(1 AS BIGINT) AS count FROM (
  SELECT seq, {_case()} AS case_id, {_norm()} AS normalized_query FROM log WHERE {_NOT_ECHO} AND ({_WRITE_SPACED} OR contains(line, 'QUERY'))
) GROUP BY case_id""",
        "catalogue_strings": _with(_STRUCTURE, _STRUCTURE_JSON) + """
SELECT DISTINCT type, tables, from_tokens, "where", columns, columns_tokens FROM texts WHERE type = 'SELECT'""",
        "statement_catalogue": _with(_STRUCTURE) + """
SELECT DISTINCT type, tables, columns, functions, conditions, operators, from_tokens FROM agg WHERE type = 'SELECT'""",
    }
