"""Pair mining invariants: counts, confidence range, partition invariance."""
from pyspark.sql import functions as F

from qtrail.operators import catalogue as C
from qtrail.operators import pairs as X
from qtrail.sources import rendered as R

from log_tables import SF_SMALL


def _log(spark):
    return R.rendered_log(spark, SF_SMALL)


def test_pair_counts_sum_to_n_minus_one(spark):
    log = _log(spark)
    ev = X.template_events(log, None, exclude_echo=True)
    n = ev.count()
    counts = X.successor_counts(ev)
    assert counts.filter(F.col("next_query").isNotNull()).agg(F.sum("count")).collect()[0][0] == n - 1
    per_case = X.successor_counts(ev.withColumn("case_id", F.get(F.split("line", " "), 2)), partition_by=["case_id"])
    cases = ev.select(F.get(F.split("line", " "), 2)).distinct().count()
    assert per_case.filter(F.col("next_query").isNotNull()).agg(F.sum("count")).collect()[0][0] == n - cases


def test_confidence_bounds(spark):
    conf = X.pair_confidence(_log(spark), None, 0)
    rows = conf.collect()
    assert rows and all(0 < r.confidence <= 1 for r in rows)
    per_query = conf.groupBy("normalized_query").agg(F.sum("confidence").alias("s")).collect()
    assert all(r.s <= 1 + 1e-12 for r in per_query)


def test_partition_invariance(spark):
    base = _log(spark)
    results = []
    for n in (1, 4, 16):
        log = base.repartition(n)
        rows = X.pair_confidence(log, C.valid_templates(log, None, 0.05), 0).collect()
        results.append(sorted(tuple(r) for r in rows))
    assert results[0] == results[1] == results[2]


def test_template_with_most_of_the_pairs(spark):
    """A template followed by a new one each time, null templates, and bounds that keep no pair without successor."""
    rows = []
    for i in range(200):
        rows += ["hot", f"t{i}"]
    rows += [None, None, "hot"]
    events = spark.createDataFrame([(i, 0, t) for i, t in enumerate(rows)], "seq bigint, c int, t string")
    want, totals = {}, {}
    for a, b in zip(rows, rows[1:] + [None]):
        totals[a] = totals.get(a, 0) + 1
        if b is not None:
            want[a, b] = want.get((a, b), 0) + 1
    for threshold in (-1, 0, 1, 5):
        got = X.sequence_confidence(events, "c", "t", ["seq"], threshold=threshold).collect()
        assert {(r[0], r[1]): (r[2], r[3], r[4]) for r in got} == {
            k: (n, totals[k[0]], n / totals[k[0]]) for k, n in want.items() if n > threshold}


def test_threshold_is_strict(spark):
    log = _log(spark)
    counts = X.consecutive_pairs(log, None, 0).collect()
    top = max(r["count"] for r in counts)
    assert all(r["count"] > top - 1 for r in X.consecutive_pairs(log, None, top - 1).collect())
    assert X.consecutive_pairs(log, None, top).count() == 0


def test_first_query_per_case_counts_one(spark):
    out = C.first_query_per_case(_log(spark)).collect()
    assert out and all(r["count"] == 1 for r in out)


def test_lines_by_table_is_the_substring_test(spark):
    log = _log(spark)
    tables = C.table_names(log).union(
        spark.createDataFrame([("ITEMS",), ("I",), ("NOPE",), ("ITEMSA1 WHERE",), ("C.USER_ID",), ("",)], "table_name string"))
    for names in (tables, tables.filter("length(table_name) > 3")):
        got = sorted(tuple(r) for r in C.lines_by_table(log, names).select("seq", "table_name").collect())
        lines = log.select("seq", "line").collect()
        known = {r[0] for r in names.collect()} - {""}
        assert got == sorted((r.seq, t) for r in lines for t in known if t in r.line)
    assert C.lines_by_table(log, tables.limit(0)).collect() == []


def test_extra_markers_and_sorts(spark):
    from log_tables import lines_df
    from qtrail.sources.auditlog import parse_audit_lines
    lines = [
        "[10/12/2024 08:00:00] 7 r TRANSACTION: DELETE FROM T WHERE ID = 1",
        "[10/12/2024 08:00:01] 7 r TRANSACTION: UPDATE T SET A = 2",
        "[10/12/2024 08:00:02] 8 r TRANSACTION: UPDATE T SET A = 3",
        "[10/12/2024 08:00:03] 8 r TRANSACTION: INSERT INTO T VALUES (4)",
    ]
    log = parse_audit_lines(lines_df(spark, lines))
    plain = {r.case_id: r.normalized_query for r in C.first_query_per_case(log).collect()}
    assert plain == {"7": "UPDATE T SET A = ?", "8": "UPDATE T SET A = ?"}
    # TRANSACTION lines count as writes too; the DELETE has no INSERT/UPDATE -> template ""
    extra = {r.case_id: r.normalized_query for r in C.first_query_per_case(log, extra_markers=("TRANSACTION",)).collect()}
    assert extra == {"7": "", "8": "UPDATE T SET A = ?"}
    counts = [r["count"] for r in C.template_counts(_log(spark), sort=True).collect()]
    assert counts == sorted(counts, reverse=True)
    conf = [r.confidence for r in X.pair_confidence(_log(spark), None, 0, sort=True).collect()]
    assert conf == sorted(conf, reverse=True)
