"""Successor / position over pieces equal the plain window forms."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from qtrail.operators import ordering
from qtrail.operators.ordering import dense_index, with_position, with_successor
from log_tables import final_part
from qtrail.operators.skew import cut_points, heavy_keys, key_hash, partitions


def _events(spark, n=300):
    rows = [(i, i % 7 if i % 11 else None, f"q{(i * 37) % 5}", i >> 3) for i in range(n)]
    return spark.createDataFrame(rows, "seq bigint, case_id int, q string, block bigint")


def test_successor_global(spark):
    df = _events(spark)
    got = {r.seq: r.next_q for r in with_successor(df, ["q"], block="block").collect()}
    ref = {r.seq: r.nq for r in df.select("seq", F.lead("q").over(Window.orderBy("seq")).alias("nq")).collect()}
    assert got == ref


def test_successor_per_case_with_null_case(spark):
    df = _events(spark).filter(F.col("seq") % 3 != 0)   # gaps and empty blocks
    got = {r.seq: r.next_q for r in with_successor(df, ["q"], block="block", partition_by=["case_id"]).collect()}
    w = Window.partitionBy("case_id").orderBy("seq")
    ref = {r.seq: r.nq for r in df.select("seq", F.lead("q").over(w).alias("nq")).collect()}
    assert got == ref


def test_position(spark):
    df = _events(spark).filter(F.col("seq") % 5 != 1)
    got = {r.seq: r.pos for r in with_position(df, block="block").collect()}
    ref = {r.seq: r.p for r in df.select("seq", (F.row_number().over(Window.orderBy("seq")) - 1).alias("p")).collect()}
    assert got == ref
    got = {r.seq: r.pos for r in with_position(df, block="block", partition_by=["case_id"]).collect()}
    w = Window.partitionBy("case_id").orderBy("seq")
    ref = {r.seq: r.p for r in df.select("seq", (F.row_number().over(w) - 1).alias("p")).collect()}
    assert got == ref


def test_dense_index(spark):
    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "k string").repartition(7)
    got = sorted((r.idx, r.k) for r in dense_index(df, ["k"], name="idx", start=1).collect())
    assert got == [(i + 1, f"k{i:04d}") for i in range(500)]


def test_sparse_blocks(spark):
    # one row per block, some blocks empty
    df = _events(spark).filter(F.col("seq") % 4 != 2).withColumn("block", F.col("seq") * 300)
    got = {r.seq: r.next_q for r in with_successor(df, ["q"], block="block").collect()}
    ref = {r.seq: r.nq for r in df.select("seq", F.lead("q").over(Window.orderBy("seq")).alias("nq")).collect()}
    assert got == ref
    got = {r.seq: r.pos for r in with_position(df, block="block").collect()}
    ref = {r.seq: r.p for r in df.select("seq", (F.row_number().over(Window.orderBy("seq")) - 1).alias("p")).collect()}
    assert got == ref


def _skewed(spark, n=4000):
    """One key with nine tenths of the rows, all of them in one minute; a null key with a
    share of its own; many light keys."""
    rows = [("hot" if i % 10 else (None if i % 20 else f"k{i % 300}"), f"2024-12-10 08:00:{i * 7919 % 60:02d}", i * 7919 % n, f"q{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, "entity string, t string, seq int, q string").selectExpr("entity", "cast(t as timestamp_ntz) ts", "seq", "q")


def test_heavy_keys_are_cut(spark):
    df = _skewed(spark).cache()
    parts = partitions(spark)
    heavy, n = heavy_keys(df, ["entity"], parts)
    counts = {r.h: r["count"] for r in df.groupBy(key_hash(["entity"]).alias("h")).count().collect()}
    assert n == 4000 and set(heavy) == {h for h, c in counts.items() if c * parts > n}
    cuts = cut_points(df, ["entity"], ["ts", "seq"]).collect()
    assert 4 <= sum(len(c._cuts) for c in cuts) <= 2 * parts
    placed, cut = ordering._in_pieces(df, ["entity"], ["ts", "seq"], None)
    sizes = placed.groupBy("entity", "_piece").count().collect()
    assert cut and max(r["count"] for r in sizes) <= 3 * 4000 / parts  # no task holds the heavy key
    # pieces follow the order
    ends = placed.filter("entity = 'hot'").groupBy("_piece").agg(F.min(F.struct("ts", "seq")).alias("a"), F.max(F.struct("ts", "seq")).alias("z")).orderBy("_piece").collect()
    assert all(tuple(p.z) < tuple(q.a) for p, q in zip(ends, ends[1:]))


def test_cut_keys_give_the_plain_result(spark):
    df = _skewed(spark).cache()
    w = Window.partitionBy("entity").orderBy("ts", "seq")
    got = with_successor(df, ["q", "seq"], order=["ts", "seq"], partition_by=["entity"])
    want = df.select("*", F.lead("q").over(w).alias("next_q"), F.lead("seq").over(w).alias("next_seq"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = with_position(df, order=["ts", "seq"], partition_by=["entity"], start=5, total="n")
    want = df.select("*", (F.row_number().over(w) + 4).cast("bigint").alias("pos"), F.count("*").over(Window.partitionBy("entity")).alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_carry_rows_are_one_per_piece(spark, monkeypatch):
    """What crosses borders is bounded by the shuffle partitions, however many keys there are."""
    seen = []
    carry = ordering.carry_rows
    monkeypatch.setattr(ordering, "carry_rows", lambda *a: seen.append(carry(*a)) or seen[-1])
    df = _skewed(spark).cache()
    with_successor(df, ["q"], order=["ts", "seq"], partition_by=["entity"])
    with_position(df, order=["ts", "seq"], partition_by=["entity"])
    assert [0 < rows.count() <= 3 * partitions(spark) for rows in seen] == [True, True]
    light = df.withColumn("entity", F.col("seq") % 500)
    with_successor(light, ["q"], order=["ts", "seq"], partition_by=["entity"])
    assert len(seen) == 2  # no heavy key: nothing crosses


def test_cut_keys_are_dealt_once(spark):
    """The rows go through one exchange; the carry rows read it again, and are broadcast."""
    df = _skewed(spark)
    out = with_successor(df, ["q"], order=["ts", "seq"], partition_by=["entity"])
    out.collect()
    plan = final_part(out._jdf.queryExecution().executedPlan().toString())
    assert plan.count("ENSURE_REQUIREMENTS") - plan.count("ReusedExchange") <= 3 and "ReusedExchange" in plan and "SinglePartition" not in plan


def test_all_rows_alike(spark):
    """Equal places of one key cannot be told apart: they stay in one piece, the result is that of one window."""
    df = spark.createDataFrame([("a", 1, "x")] * 50 + [("a", 2, "y")] * 50, "k string, seq int, q string")
    got = with_successor(df, ["q"], order=["seq"], partition_by=["k"]).groupBy("seq", "next_q").count().collect()
    assert sorted(map(str, got)) == sorted(["Row(seq=1, next_q='x', count=49)", "Row(seq=1, next_q='y', count=1)",
                                            "Row(seq=2, next_q='y', count=49)", "Row(seq=2, next_q=None, count=1)"])
    empty = df.limit(0)
    assert with_successor(empty, ["q"], order=["seq"], partition_by=["k"]).count() == 0
