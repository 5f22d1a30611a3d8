"""Line-local operators on a file stream."""
from qtrail.streaming import live as L


def test_stream_template_counts(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.log").write_bytes("\n".join([
        "[10/12/2024 08:00:00] 1 Ελεγκτης QUERY      : SELECT A FROM T WHERE P='ΑΒΓ1234' AND N = 1",
        "[10/12/2024 08:00:01] 1 Ελεγκτης QUERY      : SELECT A FROM T WHERE P='ΑΒΓ1234' AND N = 2",
        "[10/12/2024 08:00:02] 2 Ελεγκτης TRANSACTION: UPDATE T SET A = 3",
        "[10/12/2024 08:00:03] 2 Ελεγκτης INPUT      : QUERY x",
    ]).encode("cp1253"))
    log = L.stream_audit_log(spark, str(d))
    q = (L.stream_template_counts(log).writeStream.outputMode("complete").format("memory")
         .queryName("tpl_counts").option("checkpointLocation", str(tmp_path / "ck")).start())
    try:
        q.processAllAvailable()
        got = {r.normalized_query: r["count"] for r in spark.sql("SELECT * FROM tpl_counts").collect()}
    finally:
        q.stop()
    assert got == {"SELECT A FROM T WHERE P=? AND N = ?": 2, "UPDATE T SET A = ?": 1}


def test_stream_entity_counts(spark, tmp_path):
    d = tmp_path / "in2"
    d.mkdir()
    (d / "a.log").write_bytes("\n".join([
        "[10/12/2024 08:00:00] 1 Ελεγκτης QUERY      : SELECT A FROM T WHERE P='ΑΒΓ1234'",
        "[10/12/2024 08:00:01] 1 Ελεγκτης QUERY      : SELECT B FROM T WHERE P='ΑΒΓ1234'",
        "[10/12/2024 08:00:02] 2 Ελεγκτης QUERY      : SELECT A FROM T WHERE P='ΔΕΖ0001'",
        "[10/12/2024 08:00:03] 2 Ελεγκτης INPUT      : QUERY P='ΔΕΖ0001'",
        "continuation line ΔΕΖ0001",
    ]).encode("cp1253"))
    q = (L.stream_entity_counts(L.stream_audit_log(spark, str(d))).writeStream.outputMode("complete")
         .format("memory").queryName("ent_counts").option("checkpointLocation", str(tmp_path / "ck2")).start())
    try:
        q.processAllAvailable()
        got = {r.entity: r["count"] for r in spark.sql("SELECT * FROM ent_counts").collect()}
    finally:
        q.stop()
    assert got == {"ΑΒΓ1234": 2, "ΔΕΖ0001": 1}
