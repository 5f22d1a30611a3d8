"""End-to-end jobs over an audit log.

* ``mine_log``        – catalogues, pairs, confidence, traces, record groups;
* ``query_graph``     – legend, chains, chain graph, components of an edge table;
* ``trace_graph_job`` – nodes and directly-follows edges of entity traces;
* ``structure_job``   – distinct SELECT structure catalogue.

The parsed log is written once as Parquet next to the outputs and every
output reads that table, so the raw text is scanned and decoded once and the
lineage of each output is short.

Command line::

    python -m qtrail.plans.jobs mine   <log path(s)> <out dir>
    python -m qtrail.plans.jobs graph  <edge csv>    <out dir> [min] [length] [revisit]
    python -m qtrail.plans.jobs traces <trace json>  <out dir> [key] [lines|array]
    python -m qtrail.plans.jobs structure <log path(s)> <out dir>
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T
from ..operators import catalogue as C
from ..operators import graph as G
from ..operators import pairs as X
from ..operators import structure as S
from ..operators import traces as TR
from ..session import materialize
from ..sinks import files as K
from ..sources import auditlog as A
from ..sources import tables as TB


# Key columns of the nested outputs
TRACE_KEY, RECORD_KEY = "ARITH_KYKL", "ARXEISOD_ID"


def materialize_log(spark: SparkSession, log_paths, out_dir: str, codepage: str | None = A.DEFAULT_CODEPAGE
                    ) -> DataFrame:
    """Scan + parse once, write ``out_dir/events`` (Parquet), return a reader of it."""
    path = f"{out_dir.rstrip('/')}/events"
    A.read_audit_log(spark, log_paths, codepage).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def mine_log(spark: SparkSession, log_paths, out_dir: str, codepage: str | None = A.DEFAULT_CODEPAGE,
             max_count: int | None = 500, max_share: float | None = None, threshold: int = 50, plate_pattern: str = T.PLATE_PATTERN,
             record_pattern: str = T.RECORD_ID_PATTERN) -> dict[str, str]:
    """All outputs of the log-mining script; returns output name → path."""
    out = out_dir.rstrip("/")
    log = materialize_log(spark, log_paths, out, codepage)
    valid = materialize(C.valid_templates(log, max_count, max_share))
    # written first: the nested form reads it instead of mining the traces again
    TR.entity_traces(log, plate_pattern).write.mode("overwrite").parquet(f"{out}/entity_traces")
    traces = spark.read.parquet(f"{out}/entity_traces")
    outputs = {
        "first_queries_by_case": (C.first_query_per_case(log, sort=True), "csv"),
        "first_query_frequency": (C.first_query_frequency(log, sort=True), "csv"),
        "unique_cases": (C.unique_cases(log), "csv"),
        "normalized_queries": (C.template_counts(log, sort=True), "csv"),
        "frequent_query_pairs": (X.consecutive_pairs(log, valid, threshold, sort=True), "csv"),
        "confidence_query_pairs": (X.pair_confidence(log, valid, threshold, sort=True), "csv"),
        "table_names": (C.table_names(log), "csv"),
        "arith_kykl_values": (C.entity_counts(log, plate_pattern, sort=True), "csv"),
        "grouped_logs_by_arith_kykl": (TR.nest_traces(traces).withColumnRenamed("entity", TRACE_KEY), "json"),
        "grouped_queries_by_id": (TR.nest_records(TR.record_groups(log, record_pattern), RECORD_KEY), "json"),
    }
    paths = {"entity_traces": f"{out}/entity_traces"}
    for name, (df, fmt) in outputs.items():
        path = f"{out}/{name}"
        if fmt == "csv":
            K.write_csv(df, path)
        else:
            K.write_json(df, path)
        paths[name] = path
    return paths


def query_graph(spark: SparkSession, confidence: DataFrame, out_dir: str, min_confidence: float = 0.01,
                max_length: int = 5, allow_revisit: bool = False) -> dict[str, str]:
    """Legend, chains, chain graph and components of a confidence edge table."""
    out = out_dir.rstrip("/")
    confidence = materialize(confidence)
    leg = G.legend(confidence)
    edges = materialize(G.edges(confidence, leg))
    chains = G.chains(edges, min_confidence, max_length, allow_revisit, sort=True, materialized=True)
    graph = G.chain_graph(edges, min_confidence, allow_revisit)
    comps = G.query_components(graph, leg)
    K.write_legend(leg, f"{out}/query_legend")
    K.write_json(G.vertices(leg), f"{out}/query_vertices")
    K.write_json(chains, f"{out}/query_chains")
    K.write_json(graph, f"{out}/query_chain_graph")
    K.write_components(comps, f"{out}/connected_components")
    return {n: f"{out}/{n}" for n in ("query_legend", "query_vertices", "query_chains", "query_chain_graph",
                                      "connected_components")}


def trace_graph_job(spark: SparkSession, nested_traces: DataFrame, out_dir: str, key: str = TRACE_KEY) -> dict[str, str]:
    """Nodes and directly-follows edges of nested entity traces."""
    out = out_dir.rstrip("/")
    events = materialize(TR.trace_events(TB.flatten_traces(nested_traces, key)))
    nodes = TR.trace_nodes(events)
    K.write_json(nodes, f"{out}/trace_nodes")
    K.write_json(TR.trace_graph(events, nodes), f"{out}/trace_edges")
    return {"trace_nodes": f"{out}/trace_nodes", "trace_edges": f"{out}/trace_edges"}


def structure_job(spark: SparkSession, log_paths, out_dir: str, role: str = T.INSPECTOR_ROLE,
                  codepage: str | None = A.DEFAULT_CODEPAGE, single_file: bool = True) -> str:
    """Distinct SELECT structures of one role's statements, as CSV."""
    path = f"{out_dir.rstrip('/')}/extract_structure_sql"
    cat = S.statement_catalogue(A.read_statement_lines(spark, log_paths, role, codepage))
    K.write_csv(S.catalogue_strings(cat), path, single_file=single_file)
    return path


def main(argv: list[str]) -> int:
    if len(argv) < 4:
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    cmd, src, out = argv[1], argv[2], argv[3]
    if cmd == "mine":
        print(mine_log(spark, src.split(","), out))
    elif cmd == "graph":
        min_c = float(argv[4]) if len(argv) > 4 else 0.01
        length = int(argv[5]) if len(argv) > 5 else 5
        revisit = len(argv) > 6 and argv[6].lower() in ("1", "true", "yes")
        print(query_graph(spark, TB.read_edge_csv(spark, src), out, min_c, length, revisit))
    elif cmd == "traces":
        key = argv[4] if len(argv) > 4 else TRACE_KEY
        array = len(argv) > 5 and argv[5].lower() == "array"
        print(trace_graph_job(spark, TB.read_trace_json(spark, src, key, array), out, key))
    elif cmd == "structure":
        print(structure_job(spark, src.split(","), out))
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
