"""Thin queries of the training-data operators, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (embedding_dedup, hard_negatives, language_id, license_scan, line_dedup, minhash_dedup, packing, quality_rules, sentencepiece_codec,
               sharding, token_counts, toxicity, whitening)
from ._common import fold, load, prepare, stored

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_metric_join(spark, sf_dir):
    """Links, component and verdict of every vector."""
    prepare(spark, 4096)
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op2_quality_ratio(spark, sf_dir):
    """Base figures, log-likelihood ratio and verdict of every document."""
    prepare(spark)
    return quality_rules.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_unigram_counts(spark, sf_dir):
    """Token count of every document."""
    prepare(spark)
    return token_counts.token_counts(load(spark, sf_dir, "documents"), PIECES)


def op4_kneser_ney_language(spark, sf_dir):
    """Language of every document; the fold of remainder 1 is held out of learning."""
    prepare(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = language_id.fit(docs.filter(~held_out))
    return language_id.identify(docs, model).withColumn("held_out", held_out)


def op5_subsequence_toxicity(spark, sf_dir):
    """Toxicity score of every document; the fold of remainder 0 is held out of learning."""
    prepare(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(toxicity.training_rows(docs, load(spark, sf_dir, "labels"), ~held_out))
    return toxicity.toxicity(docs, model).withColumn("held_out", held_out)


def op6_sentencepiece(spark, sf_dir):
    """Digests of every document's ids and of the text they decode to."""
    prepare(spark)
    return sentencepiece_codec.digests(load(spark, sf_dir, "documents"), PIECES)


def op7_retrieval_packing(spark, sf_dir):
    """Pieces of all documents in windows of 4096 ids."""
    prepare(spark)
    return packing.pack(load(spark, sf_dir, "documents"), WORDS)


def op8_minhash_bayes(spark, sf_dir):
    """Near-duplicate component of every document."""
    prepare(spark)
    return minhash_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op9_line_windows(spark, sf_dir):
    """Digest of every document after line dedup."""
    done = line_dedup.dedup_lines(load(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars_left"),
                       F.md5("text").alias("text_md5"))


def op10_license_scan(spark, sf_dir):
    """License notices of every document."""
    return license_scan.scan(load(spark, sf_dir, "documents"))


def op11_hilbert_shards(spark, sf_dir):
    """Shard and place of every document; metadata and digests alone are ordered, texts are read once."""
    docs = load(spark, sf_dir, "documents")
    text = F.col("text")
    narrow, _ = stored(docs.select("doc_id", "lang", "source", "n_chars", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
                                   F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32")), "shard-rows")
    return sharding.hilbert_shards(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op12_cholesky_whitening(spark, sf_dir):
    """Whitened components of every embedding."""
    prepare(spark, 4096)
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


def op13_onebit_negatives(spark, sf_dir):
    """Hard negatives of the embeddings whose id is divisible by 50; every seventh id has the next label."""
    prepare(spark, 4096)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(load(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


_ALL = (op1_embedding_metric_join, op2_quality_ratio, op3_unigram_counts, op4_kneser_ney_language, op5_subsequence_toxicity,
        op6_sentencepiece, op7_retrieval_packing, op8_minhash_bayes,
        op9_line_windows, op10_license_scan, op11_hilbert_shards, op12_cholesky_whitening, op13_onebit_negatives)


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql():
    """DuckDB SQL of the operators that SQL expresses."""
    return {"op9_line_windows": line_dedup.SQL, "op10_license_scan": license_scan.sql()}
