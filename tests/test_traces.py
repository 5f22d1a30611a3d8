"""Traces: dedupe, order, nested chunks, directly-follows graph with last label."""
import datetime as dt

from qtrail.operators import traces as TR
from qtrail.sources.auditlog import parse_audit_lines

from log_tables import lines_df

L = [
    "[10/12/2024 08:00:00] 1 r QUERY      : SELECT A FROM T WHERE P='ΑΒΓ1234'",
    "[10/12/2024 08:00:00] 1 r QUERY      : SELECT A FROM T WHERE P='ΑΒΓ1234'",   # exact duplicate
    "[10/12/2024 08:00:05] 1 r QUERY      : SELECT B FROM U WHERE P='ΑΒΓ1234'",
    "[10/12/2024 08:00:03] 2 r QUERY      : SELECT A FROM T WHERE P='ΔΕΖ0001'",
    "[10/12/2024 08:01:07] 1 r QUERY      : SELECT A FROM T WHERE P='ΑΒΓ1234'",
    "[10/12/2024 08:02:09] 1 r QUERY      : SELECT B FROM U WHERE P='ΑΒΓ1234'",
    "[10/12/2024 08:03:00] 1 r INPUT      : QUERY x WHERE P='ΑΒΓ1234'",            # echo: dropped
    "[10/12/2024 08:04:00] 1 r QUERY      : SELECT C FROM V WHERE K=1",              # no entity
]


def test_entity_traces_and_graph(spark):
    log = parse_audit_lines(lines_df(spark, L))
    flat = TR.entity_traces(log)
    rows = sorted((r.entity, r.pos, r.query_count, r.normalized_line[-22:]) for r in flat.collect())
    assert [(e, p, n) for e, p, n, _ in rows] == [("ΑΒΓ1234", i, 4) for i in range(4)] + [("ΔΕΖ0001", 0, 1)]
    nested = TR.nest_traces(flat, chunk_size=3).orderBy("entity", "chunk").collect()
    assert [(r.entity, r.chunk, len(r.grouped_lines)) for r in nested] == [("ΑΒΓ1234", 0, 3), ("ΑΒΓ1234", 1, 1),
                                                                           ("ΔΕΖ0001", 0, 1)]
    assert nested[0].grouped_lines[0].timestamp == dt.datetime(2024, 12, 10, 8, 0, 0)

    ev = TR.trace_events(flat)
    nodes = {(r.entity, r.query_text): r.node_id for r in TR.trace_nodes(ev).collect()}
    assert nodes == {("ΑΒΓ1234", "SELECT A FROM T"): 0, ("ΑΒΓ1234", "SELECT B FROM U"): 1,
                     ("ΔΕΖ0001", "SELECT A FROM T"): 2}
    edges = {(r.start_node, r.end_node): (r.label, r["count"]) for r in TR.trace_graph(ev, TR.trace_nodes(ev)).collect()}
    # A→B twice (labels 08:00:05 then 08:02:09: last wins), B→A once
    assert edges == {(0, 1): ("08:02:09", 2), (1, 0): ("08:01:07", 1)}


def test_record_groups_keep_duplicates(spark):
    lines = [
        "[10/12/2024 08:00:00] 1 r QUERY      : SELECT * FROM ARXEISOD WHERE ARXEISOD.ID = 5",
        "[10/12/2024 08:00:00] 1 r QUERY      : SELECT * FROM ARXEISOD WHERE ARXEISOD.ID = 5",
        "[10/12/2024 08:00:01] 1 r QUERY      : SELECT * FROM ARXEISOD WHERE (ARXEISOD.ID = 6)",
        "[10/12/2024 08:00:02] 1 r TRANSACTION: UPDATE ARXEISOD SET X=1 WHERE ARXEISOD.ID = 5",
    ]
    out = TR.record_groups(parse_audit_lines(lines_df(spark, lines))).orderBy("record_id", "pos").collect()
    assert [(r.record_id, r.pos) for r in out] == [("5", 0), ("5", 1), ("5", 2)]
