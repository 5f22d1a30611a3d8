"""Operator 2: quality rules with a hashed n-gram log-likelihood ratio.

Every whole text gets the base figures of the rules and the mean over its
hashed n-grams (1- and 2-grams of words and of word shapes, each kind with
buckets of its own) of

    log P(bucket | trusted target) - log P(bucket | raw corpus),

two add-one smoothed multinomials.  The raw corpus is every text; the trusted
target is every text whose label says good quality.  Half of it, by a hash of
the id, gives the counts; all of the other half, which the counts have not seen,
sets the threshold:
``KEEP_SHARE`` of its ratios lie at or above it, less their spread from there to
the median, as a sample's quantile is uncertain by the order of it.  A text is kept
when it passes the base rules and its ratio reaches the threshold.  All of this
follows from the tables alone, so a run repeats to the bit.

Only two tables of ``BUCKETS`` counts and a histogram of ratios reach the
driver, whatever the input's size.  For the counts the trusted ids are joined with
the texts whose id falls into their half, for the threshold with the judged figures
alone.  Exact copies, hot sources or long texts need no care: there is no shuffle by
text.  A hot id is split by the adaptive join; rows without an id are trusted by no
label and stay out of it.

Defined results: null, empty and blank texts have no word, so they fail the
base rules (n_words < 20); repeated rows are judged alike, each for itself; a
null id is passed on; without labels the raw corpus is the target, so every
ratio is 0 and the base rules alone decide; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, mix, rolling, stored

# buckets of the kinds of n-gram: words, pairs of words, shapes, pairs of shapes
KINDS = (1 << 14, 1 << 12, 1 << 12, 1 << 12)
BUCKETS = sum(KINDS)
KEEP_SHARE = 0.998
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
BINS, LOW, HIGH = 4000, -10.0, 10.0
SYMBOLS = b"#*$%&|<>"
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_COUNTED = _BLANK + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)

BASE = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean")


# the shape of a word: its letters as a, its digits as 0, each run once, the rest as it is
_SHAPE = bytes(ord("0") if 48 <= b <= 57 else ord("a") if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUNS = re.compile(rb"a{2,}|0{2,}")


def shape_hashes(text: bytes) -> np.ndarray:
    return word_hashes(_RUNS.sub(lambda m: m[0][:1], text.translate(_SHAPE)))


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()  # bytes: ASCII white space only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    if len(words) <= window:
        return 0
    seen, inverse, count = np.unique(rolling(words, window), return_inverse=True, return_counts=True)
    if len(seen) == len(inverse):
        return 0
    again = count[inverse] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    cover[starts] += 1
    np.subtract.at(cover, starts + window, 1)
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


def base_figures(text: bytes, words: np.ndarray) -> tuple:
    repeat = repeated_words(words)
    n = len(words)
    return (n, len(text.translate(None, _NOT_COUNTED)), len(text.translate(None, _NOT_SYMBOL)), duplicate_lines(text),
            repeat, n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n)


def gram_buckets(text: bytes, words: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of a text."""
    shapes = shape_hashes(text)
    grams = (mix(words), rolling(words, 2), mix(shapes), rolling(shapes, 2))
    first = np.cumsum((0, *KINDS[:-1]))
    return np.concatenate([(g % U64(size)).astype(np.int64) + at for g, size, at in zip(grams, KINDS, first)])


def _counts(batches):
    """Bucket counts of a partition's texts: raw corpus and trusted target."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, trusted in zip(batch.column("text").to_pylist(), batch.column("trusted").to_pylist()):
            if text:
                buckets = gram_buckets(text, word_hashes(text))
                np.add.at(raw, buckets, 1)
                if trusted:
                    np.add.at(target, buckets, 1)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(raw[used]), pa.array(target[used])],
                                     names=["bucket", "raw", "target"])


def ratio(text: bytes, words: np.ndarray, weight: np.ndarray) -> float:
    """Mean log-likelihood ratio of a text's n-grams; 0 without any."""
    return float(weight[gram_buckets(text, words)].mean()) if len(words) else 0.0


def _judged(batches, weight):
    names = [c.split()[0] for c in BASE.split(", ")]
    for batch in batches:
        rows, ratios = [], []
        for text in batch.column("text").to_pylist():
            words = word_hashes(text or b"")
            rows.append(base_figures(text or b"", words))
            ratios.append(ratio(text or b"", words, weight.value))
        columns = list(zip(*rows)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.bool_() if n == "base_failed" else pa.int64())
                                       for n, c in zip(names, columns)), pa.array(ratios, pa.float64())],
            names=["doc_id", *names, "log_ratio"])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base figures, log_ratio, threshold, kept: one row per row of ``docs``.

    ``labels`` has ``doc_id`` and ``quality`` (1: trusted).  Two passes over the
    texts, both run while this is built: one for the counts, one for the figures,
    which are written."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    fit = F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0)
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint")).distinct()
    # the hash tells which texts cannot count for the target: only the others meet the ids
    marked = (src.filter(fit).join(trusted.filter(fit).withColumn("trusted", F.lit(True)).hint("shuffle_hash"), "doc_id", "left")
              .unionByName(src.filter(~fit).withColumn("trusted", F.lit(False))))
    counts = (marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
              .mapInArrow(_counts, "bucket bigint, raw bigint, target bigint")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"] if counts["target"].sum() else counts["raw"]
    kind = np.repeat(np.arange(len(KINDS)), KINDS)
    share = lambda c: np.log(c / np.bincount(kind, c)[kind])  # noqa: E731  one multinomial for each kind
    weight = spark.sparkContext.broadcast(share(target) - share(raw))
    columns = f"doc_id bigint, {BASE}, log_ratio double"
    judged, _ = stored(src.mapInArrow(lambda b: _judged(b, weight), columns), "judged")
    threshold = _threshold(judged.join(trusted.filter(~fit), "doc_id", "left_semi"))
    return (judged.withColumn("threshold", F.lit(threshold))
            .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= F.col("threshold"))))


def _threshold(target: DataFrame) -> float:
    """The lower edge of the histogram bin that leaves ``KEEP_SHARE`` of the target above, less
    the distance to the median's bin; ``LOW`` without a target."""
    place = F.least(F.greatest(F.floor((F.col("log_ratio") - LOW) / (HIGH - LOW) * BINS), F.lit(0)), F.lit(BINS - 1))
    found = (target.filter(~F.col("base_failed")).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("k"))
             .toPandas().sort_values("bin"))
    if not len(found):
        return LOW
    first, middle = (found["bin"][found["k"].cumsum() > share * found["k"].sum()].iloc[0] for share in (1 - KEEP_SHARE, 0.5))
    return LOW + float(first - max(middle - first, 0)) * (HIGH - LOW) / BINS
