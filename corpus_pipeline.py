"""Corpus pipeline: toxicity, language, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  What a stage rejects is gone for the next.

Defined results, besides those of the operators: a table without labels or
without languages rejects nothing for want of a model in the toxicity stage and
everything in the language stage (no text has a known language); extra columns
are passed on up to packing; ``n_chars``, if present, follows the cleaned text;
rows that repeat an id and all its columns leave the near-duplicate stage once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qtrail.llm import language_id, line_dedup, minhash_dedup, packing, toxicity
from qtrail.llm._common import fold, load, prepare, stored
from qtrail.llm.queries import WORDS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5 (operator 5, the labels of its learning folds)."""
    prepare(spark)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(toxicity.training_rows(docs, load(spark, sf_dir, "labels"), ~held_out))
    return docs.filter(toxicity.score_column(model)("text") < 0.5)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted (operator 4, learnt from its learning folds)."""
    prepare(spark)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = language_id.fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    if model is None:
        return docs.limit(0)
    return docs.filter(language_id.accepted(model)("text"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of three-line passages (operator 9)."""
    prepare(spark)
    cleaned = line_dedup.dedup_lines(docs, figures=False)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest id (operator 8)."""
    prepare(spark)
    gone, _ = stored(minhash_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "near-duplicates")
    left = docs.join(gone.hint("merge"), "doc_id", "left_anti")  # grows with the data: one plan at every size
    twice, _ = stored(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
                      .filter("k > 1").select("doc_id"), "repeated-ids")
    again = left.join(twice, "doc_id", "left_semi").dropDuplicates()
    return left.join(twice, "doc_id", "left_anti").unionByName(again).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 ids (operator 7)."""
    prepare(spark)
    return packing.pack(docs, WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

# models, MinHash and packing have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
