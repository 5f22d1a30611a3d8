import random

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from llm_tables import frame, words
from qtrail.llm import queries


def corpus(spark, folder):
    rng = random.Random(7)
    rows = [(i, words(rng, 60) + ("\nyou idiot moron\n" if i % 6 == 0 else "\n") + words(rng, 40), "en", "s", 5, "r", 1, "x", "b")
            for i in range(200)]
    rows += [(500, rows[1][1], "en", "s", 5, "r", 1, "x", "b"), (501, None, None, None, None, None, None, None, None), (502, "", "en", "s", 0, "r", 1, "x", "b"),
             (503, " ".join("".join(rng.choice("qxzwvk") for _ in range(9)) for _ in range(80)), None, "s", 5, "r", 1, "x", "b")]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    left = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = {i for i in range(200) if i % 6}
    assert left["toxicity"] == clean | {500, 501, 502, 503}
    assert left["language"] == clean | {500}
    assert left["line_dedup"] == left["language"]
    assert left["near_duplicates"] == clean
    pieces = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == clean
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == clean


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(queries.oracle_sql()) <= set(names)
