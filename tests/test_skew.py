"""Heavy keys: found, cut, and judged without being dealt."""
from pyspark.sql import functions as F

from log_tables import SF_SMALL
from qtrail.operators import catalogue as C
from qtrail.operators import pairs as X
from qtrail.operators import skew
from qtrail.sources import rendered as R


def _rows(spark):
    return spark.range(8000).select(F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 8, F.lit(None))
                                    .otherwise(F.concat(F.lit("k"), F.col("id") % 333)).alias("k"), "id")


def test_written_rows_tell_their_heavy_keys(spark):
    table, (heavy, n) = skew.written(_rows(spark), ["k"])
    assert n == 8000 and table.count() == 8000
    hashes = {r.h: r.k for r in table.select(skew.key_hash(["k"]).alias("h"), "k").distinct().collect()}
    assert {hashes[h] for h in heavy} == {"hot", None}
    assert skew.heavy_keys(_rows(spark), ["k"])[0].keys() == heavy.keys()
    assert skew.heavy_keys(_rows(spark).limit(0), ["k"]) == ({}, 0)


def test_only_keys_is_the_semi_join(spark):
    table, (heavy, _) = skew.written(_rows(spark), ["k"])
    for keys in (["hot", "k1", "k7", "none"], ["k1", "k7"], [], [None, "hot"]):
        known = spark.createDataFrame([(k,) for k in keys], "k string")
        got = sorted(r.id for r in skew.only_keys(table, known, "k", heavy).collect())
        assert got == sorted(r.id for r in table.filter(F.col("k").isin([k for k in keys if k])).collect())


def test_no_task_gets_a_heavy_key(spark):
    """Broadcast off: what the join deals has no key of more than a share, so no task has twice the median's rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table, (heavy, _) = skew.written(_rows(spark), ["k"])
        known = table.select("k").filter("k is not null").distinct()
        out = skew.only_keys(table, known, "k", heavy)
        assert out.count() == 6400
        tail = table.filter(~skew.key_hash(["k"]).isin(list(heavy)))
        sizes = sorted(r["count"] for r in tail.repartition(8, "k").groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rule_equals_a_given_valid_set(spark):
    log = R.rendered_log(spark, SF_SMALL)
    for rule in ((None, 0.05), (20, None), (20, 0.01)):
        valid = C.valid_templates(log, *rule)
        for echo in (True, False):
            a = C.positioned_templates(log, valid, exclude_echo=echo).select("seq", "row_id", "normalized_query")
            b = C.positioned_templates(log, exclude_echo=echo, rule=rule).select("seq", "row_id", "normalized_query")
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        a, b = X.pair_confidence(log, valid, 0, partition_by=["case_id"]), X.pair_confidence(log, None, 0, partition_by=["case_id"], rule=rule)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
