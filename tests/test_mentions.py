"""Rarest-gram index: the substring test, and how many rows it makes on the way."""
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from log_tables import SF_SMALL
from qtrail.operators import catalogue as C
from qtrail.operators import mentions as M
from qtrail.sources import rendered as R


def _plain(texts, names):
    return sorted((i, n) for i, t in texts for n in set(names) if t and n and n in t)


def _got(spark, texts, names):
    t = spark.createDataFrame(texts, "id int, text string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    return sorted(tuple(r) for r in M.mentions(t, "text", n, "name").select("id", "name").collect())


def test_is_the_substring_test(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("AB_") for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["", None, "A", "A", "ΑΒΓ", "naïve ﬁ", "A B", "."]
    texts = [(i, "".join(rng.choice("AB_ Γ.") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    texts += [(900, None), (901, ""), (902, "x ΑΒΓ naïve ﬁ 😀"), (903, "A")]
    assert _got(spark, texts, names) == _plain(texts, names)


def test_long_texts_across_chunks(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    names = [text[i:i + n] for i, n in ((250, 12), (255, 3), (256, 8), (511, 2), (19_990, 10), (0, 9))] + ["zz", "zzzzzzzzz"]
    assert _got(spark, [(1, text), (2, text[300:])], names) == _plain([(1, text), (2, text[300:])], names)


def test_no_names(spark):
    assert _got(spark, [(1, "a")], []) == [] and _got(spark, [(1, "a")], ["", None]) == []
    assert _got(spark, [], ["a"]) == []


def test_one_prefix_for_all_names(spark):
    """500 names of one prefix: the anchor is a gram behind it, a text meets its own names only."""
    names = [f"COMMON_SCHEMA_T{i:03d}" for i in range(500)]
    texts = [(i, f"SELECT A FROM COMMON_SCHEMA_T{i % 500:03d} WHERE COMMON_SCHEMA = {i}") for i in range(2000)]
    t = spark.createDataFrame(texts, "id int, text string")
    found = M.candidates(t, "text", spark.createDataFrame([(n,) for n in names], "name string"), "name")
    rows = found.count()
    assert 2000 <= rows <= 2.5 * 2000
    assert _got(spark, texts, names) == _plain(texts, names)


def test_rows_on_the_way_are_near_the_hits(spark):
    """Exploded grams and candidates of the rendered log: at most three times the hits."""
    log = R.rendered_log(spark, "/root/testdata/sf0.01").select("seq", "ts", "line").cache()
    names = C.table_names(log)
    hits = C.lines_by_table(log, names).count()
    found = M.candidates(log, "line", names, "table_name")
    exploded = found.select("seq", "gram").distinct().count()
    assert exploded + found.count() <= 3 * hits
    log.unpersist()


def test_filter_has_no_false_negatives(spark):
    values = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("v"))
    holds = M.bloom(values, "v", 5000)
    assert values.filter(holds(F.xxhash64("v"))).count() == 5000
    other = spark.range(20000).select(F.concat(F.lit("w"), "id").alias("v"))
    assert other.filter(holds(F.xxhash64("v"))).count() < 200


def test_lines_by_table_reads_columns_once_parsed(spark):
    log = R.rendered_log(spark, SF_SMALL)
    assert C.lines_by_table(log, C.table_names(log)).columns == ["seq", "ts", "table_name", "line"]


def test_grams_are_made_by_arrays(spark):
    """No lambda is evaluated for each gram of each line: the plan makes them a batch at a time."""
    t = spark.createDataFrame([(1, "UPDATE A_TABLE SET B")], "id int, text string")
    found = M.candidates(t, "text", spark.createDataFrame([("A_TABLE",), ("B",)], "name string"), "name")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan


def test_grams_of_a_column(monkeypatch):
    monkeypatch.setattr(M, "_PART", 7)
    rng = random.Random(5)
    texts = [None, "", "ab", *("".join(rng.choice("abΓ😀 ") for _ in range(rng.randint(0, 40))) for _ in range(50)), None, ""]
    for column, rows in ((pa.array(texts), texts), (pa.array(texts).slice(3, 20), texts[3:23]), (pa.array([], pa.string()), [])):
        number = lambda g: int(M.grams(np.frombuffer(g, np.uint8), len(g))[0])
        plain = sorted({(k, number(b[i:i + q])) for k, t in enumerate(rows) for b in [(t or "").encode()] for q in M.LENGTHS
                        for i in range(len(b) - q + 1)})
        row, gram = M.grams_in(column, M.LENGTHS)
        assert list(zip(row.tolist(), gram.tolist())) == plain


def test_filter_is_one_in_columns_and_arrays(spark):
    values = spark.range(300).select((F.col("id") * 7919 * 1_000_003).alias("v"))
    holds = M.bloom(values, "v", 20)  # crowded
    hashes = np.array([r[0] for r in spark.range(3000).select(F.xxhash64("id")).collect()], np.int64)
    by_column = spark.createDataFrame([(i, int(h)) for i, h in enumerate(hashes)], "i int, h bigint").filter(holds(F.col("h")))
    at = holds.places(hashes.view(np.uint64)).tolist()
    assert 0 < len(at) < 3000 and at == sorted(r.i for r in by_column.collect())
