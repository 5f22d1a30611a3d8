import random

import duckdb
import pytest

from llm_tables import docs, edge_rows, frame, words
from qtrail.llm import license_scan as S
from qtrail.llm import line_dedup as D


def duck(table, sql):
    con = duckdb.connect()
    con.register("documents", table.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    rel = con.sql("SELECT * FROM (" + sql + ")")
    return rel.columns, sorted(map(str, rel.fetchall()))


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    return not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


def lined(rng):
    """Texts that share passages of three lines and more, also within a text."""
    shared = [words(rng, 6) for _ in range(12)]
    out = []
    for i in range(60):
        own = [words(rng, 5) for _ in range(4)]
        at, n = rng.randrange(8), rng.randrange(2, 5)
        lines = own[:2] + shared[at:at + n] + own[2:] + (shared[at:at + n] if i % 7 == 0 else [])
        out.append("\n".join(lines))
    return out + ["a\n\n\n\n\nb", "c\n \n\n\t\nd", "\n".join(shared), "\n".join(shared), "one\ntwo", "x\nx\nx\nx\nx\nx"]


def test_line_dedup_against_sql(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    table = docs(spark, lined(random.Random(1))).union(frame(spark, rows)).cache()
    done = D.dedup_lines(table)
    assert no_python(done)
    got = done.selectExpr("doc_id", "n_lines", "n_removed", "cast(length(text) as bigint) n_chars_left", "md5(text) text_md5")
    columns, expected = duck(table, D.SQL)
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == expected
    assert done.filter("n_removed > 0").count() > 30


def test_line_dedup_edges(spark):
    table = frame(spark, edge_rows()).withColumn("n_lines", D.F.lit("own"))
    done = D.dedup_lines(table, figures=False)
    assert done.columns == table.columns
    assert sorted(map(str, done.collect())) == sorted(map(str, table.collect()))
    assert D.dedup_lines(frame(spark, [])).collect() == []
    # equal rows are one occurrence; a null id sorts first
    text = "a\nb\nc"
    rows = [(i, t, None, None, None, "r", 1, "s", "b") for i, t in [(1, text), (1, text), (2, text + "\nd"), (None, text)]]
    got = sorted((str(r.doc_id), r.text) for r in D.dedup_lines(frame(spark, rows)).collect())
    assert got == [("1", ""), ("1", ""), ("2", "d"), ("None", text)]


def test_long_text_is_linear(spark):
    text = "\n".join(f"line {i % 5000}" for i in range(20_000))
    row = D.dedup_lines(docs(spark, [text])).first()
    assert (row.n_lines, row.n_removed, row.text) == (20_000, 15_000, "\n".join(text.split("\n")[:5000]))


@pytest.fixture(scope="module")
def noticed(spark):
    rng = random.Random(2)
    texts = []
    for i, (_, notice) in enumerate(S.NOTICES):
        texts += [notice, notice.upper(), words(rng, 50 + i) + "\n" + notice + "\n" + words(rng, 30),
                  words(rng, 7 + i) + " " + notice.replace(" ", "  ")[:-1] + " " + words(rng, 3),
                  " ".join(notice.split()[:-1] + ["other"]), " ".join(notice.split()[1:])]
    return docs(spark, texts + [words(rng, 3000) for _ in range(10)]).union(frame(spark, edge_rows())).cache()


def test_license_scan_against_sql(spark, noticed):
    found = S.scan(noticed)
    assert no_python(found)
    columns, expected = duck(noticed, S.sql())
    assert sorted(str(tuple(r)) for r in found.select(columns).collect()) == expected
    assert len(expected) >= 4 * len(S.NOTICES)


def test_license_scan_edges(spark):
    assert S.scan(frame(spark, edge_rows())).collect() == []
    assert S.scan(frame(spark, [])).collect() == []
    short = S.scan(docs(spark, ["all rights reserved", "x all rights reserved", None]), [("arr", "All Rights Reserved.")]).collect()
    assert [(r.doc_id, r.n_shared, r.n_template) for r in short] == [(100, 1, 1)]


def test_license_scan_recall_without_negative_hashes(spark):
    """Copied notices are retrieved also where every pair's hash is non-negative or only one is negative."""
    rng = random.Random(4)
    drawn = spark.createDataFrame([(i, words(rng, 5)) for i in range(1500)], "name string, text string")
    pairs = S._pairs(S._words(S.F.col("text")))
    chosen = [(r.name, r.text) for r in drawn.withColumn("low", S.F.size(S.F.filter(pairs, lambda x: x < 0)))
              .filter("low <= 1").orderBy("low", "name").limit(100).collect()]
    assert len(chosen) == 100
    for part in range(0, 100, 20):
        some = chosen[part:part + 20]
        texts = [words(rng, 40 + lead) + " " + text + " " + words(rng, 20) for _, text in some for lead in range(4)]
        got = {(r.doc_id, r.license) for r in S.scan(docs(spark, texts), some).collect()}
        assert len({(100 + 4 * i + lead, name) for i, (name, _) in enumerate(some) for lead in range(4)} - got) == 0
