"""Sinks/sources round trips and the end-to-end jobs on a log file."""
import pytest
from pyspark.sql import functions as F

from qtrail.plans import jobs as J
from qtrail.sinks import files as K
from qtrail.sources import rendered as R
from qtrail.sources import tables as TB

from log_tables import SF_SMALL


def test_csv_round_trip(spark, tmp_path):
    rows = [("SELECT A, B FROM T WHERE X = \"q\" AND Y = '\\'", "UPDATE T", 3, 4, 0.75)]
    df = spark.createDataFrame(rows, TB.EDGE_SCHEMA)
    K.write_csv(df, str(tmp_path / "edges"))
    back = TB.read_edge_csv(spark, str(tmp_path / "edges")).collect()
    assert [tuple(r) for r in back] == rows


def test_trace_json_round_trip(spark, tmp_path):
    log = R.rendered_log(spark, SF_SMALL)
    from qtrail.operators import traces as TR
    flat = TR.entity_traces(log, R.RENDERED_PLATE_PATTERN)
    K.write_json(TR.nest_traces(flat, chunk_size=2), str(tmp_path / "tr"))
    again = TB.flatten_traces(TB.read_trace_json(spark, str(tmp_path / "tr")))
    a = sorted((r.entity, r.pos, r.ts, r.normalized_line) for r in flat.collect())
    b = sorted((r.entity, r.pos, r.ts, r.normalized_line) for r in again.collect())
    assert a == b


def test_edge_csv_by_header_name(spark, tmp_path):
    (tmp_path / "edges.csv").write_text("confidence,next_query,extra,normalized_query,count\n0.5,B,x,A,2\n,D,x,C,\n")
    rows = TB.read_edge_csv(spark, str(tmp_path / "edges.csv")).collect()
    assert [tuple(r) for r in rows] == [("A", "B", 2, None, 0.5), ("C", "D", None, None, None)]
    (tmp_path / "bad.csv").write_text("normalized_query,next_query,count\nA,B,many\n")
    with pytest.raises(Exception, match="cannot read many"):
        TB.read_edge_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_trace_array_with_and_without_zone(spark, tmp_path):
    (tmp_path / "t.json").write_text("""[
 {"ARITH_KYKL": "ABC1234", "query_count": 4, "grouped_lines": [
   {"timestamp": "2024-12-10T08:00:03.000+02:00", "normalized_line": "c"}, {"timestamp": "2024-12-10 08:00:01", "normalized_line": "a"},
   {"timestamp": "2024-12-10T08:00:02Z", "normalized_line": "b"}, {"timestamp": "2024-12-10T08:00:04.500-0530", "normalized_line": "d"}]}
]""")
    flat = TB.flatten_traces(TB.read_trace_json(spark, str(tmp_path / "t.json"), "ARITH_KYKL", True), "ARITH_KYKL")
    rows = sorted((r.pos, r.entity, r.ts.isoformat(), r.normalized_line) for r in flat.collect())
    assert rows == [(0, "ABC1234", "2024-12-10T08:00:01", "a"), (1, "ABC1234", "2024-12-10T08:00:02", "b"),
                    (2, "ABC1234", "2024-12-10T08:00:03", "c"), (3, "ABC1234", "2024-12-10T08:00:04.500000", "d")]
    (tmp_path / "bad.json").write_text('{"entity": "E", "grouped_lines": [{"timestamp": "noon", "normalized_line": "a"}]}')
    with pytest.raises(Exception, match="cannot read noon"):
        TB.read_trace_json(spark, str(tmp_path / "bad.json")).collect()


def _write_log(spark, path):
    """The rendered log as a text file (ASCII, so cp1253 = UTF-8 bytes), file order = event order."""
    raw = R.rendered_raw(spark, SF_SMALL).orderBy("seq").select("value")
    raw.coalesce(1).write.mode("overwrite").text(path)


def test_mine_log_job(spark, tmp_path):
    logdir = str(tmp_path / "log")
    _write_log(spark, logdir)
    out = J.mine_log(spark, logdir, str(tmp_path / "out"), max_count=None, threshold=0,
                     plate_pattern=R.RENDERED_PLATE_PATTERN, record_pattern=R.RENDERED_RECORD_ID_PATTERN)
    counts = spark.read.option("header", True).csv(out["normalized_queries"])
    from qtrail.operators import catalogue as C
    assert counts.count() == C.template_counts(R.rendered_log(spark, SF_SMALL)).count() > 50
    conf = TB.read_edge_csv(spark, out["confidence_query_pairs"])
    direct = R.rendered_log(spark, SF_SMALL)
    from qtrail.operators import pairs as X
    assert sorted(tuple(r) for r in conf.collect()) == sorted(tuple(r) for r in X.pair_confidence(direct, None, 0).collect())
    frequent = conf.filter("count >= 3")
    graph = J.query_graph(spark, frequent, str(tmp_path / "graph"), 0.05, 2)
    assert spark.read.option("header", True).csv(graph["query_legend"]).columns == ["Query", "ID"]
    comps = spark.read.json(graph["connected_components"]).collect()
    on_edges = frequent.filter("confidence >= 0.05 and normalized_query <> next_query")
    assert sum(len(c.queries) for c in comps) == on_edges.select(F.explode(F.array("normalized_query", "next_query"))).distinct().count()
    traces = J.trace_graph_job(spark, TB.read_trace_json(spark, out["grouped_logs_by_arith_kykl"], J.TRACE_KEY),
                               str(tmp_path / "tg"))
    records = spark.read.json(out["grouped_queries_by_id"])
    assert set(records.columns) == {J.RECORD_KEY, "chunk", "grouped_lines"}
    assert records.select(F.max(F.size("grouped_lines"))).first()[0] > 1
    assert spark.read.json(traces["trace_nodes"]).count() > 0
    path = J.structure_job(spark, logdir, str(tmp_path / "st"), role=R.ROLE)
    cat = spark.read.option("header", True).option("escape", '"').csv(path)
    assert {r.tables for r in cat.collect()} >= {"C,I", "ITEMSA1"}
