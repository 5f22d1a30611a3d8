"""Operator 10: license scan (DataFrame functions only).

Texts and templates become lower-case words (runs of letters, digits, ``.``, ``-``
and ``+``, without full stops at the end).  Windows of ``WINDOW`` words, ``STRIDE`` apart, overlap so
that every passage lies mostly in one.  Each window's set of word pairs has
``BANDS`` minima of separately seeded hashes, one row to a band: a window with similarity s to a window of a
template shares a band with probability 1 - (1 - s)^16.  Template windows start at
every word, so a copied template has a text window with s >= 0.5 whatever its
place and length (1 from 11 words on), which means at least 0.99998.  Retrieved
templates are then verified exactly: at least ``PERCENT`` of the template's
distinct five-word shingles occur in the text.

Templates are a parameter: a short list, so their minima travel as literals and
nothing is shuffled; every row is judged where it is read.

Defined results: null, empty or wordless texts match nothing; templates of fewer
than five words are one shingle of all their words and need ``WINDOW`` >= 2 words;
a row that repeats is reported as often; a null id is passed on; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pin

SHINGLE, PERCENT = 5, 75
WINDOW, STRIDE, BANDS = 8, 4, 16
#: Common notices (name, text)
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit", "Released under the MIT License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                       "associated documentation files, to deal in the software without restriction."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _words(text):
    """Words of a text column; no full stop at a word's end.  A text without words gives one empty word."""
    plain = F.regexp_replace(F.lower(text), r"(?:[^\p{L}\p{N}.+-]|\.+(?![\p{L}\p{N}.+-]))++", " ")
    return F.split(F.trim(plain), " ")


def _pairs(words):
    """Hash of each pair of neighbouring words."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)),
                      lambda a, b: F.xxhash64(a, b))


def _with_minima(df: DataFrame, starts) -> DataFrame:
    """Add the minima m0, m1, ... of the windows that start at the given pairs (counted from 1):
    for each band the pair with the lowest hash seeded by the band."""
    def lowest(k):
        return F.transform("starts", lambda i: F.array_min(F.transform(
            F.slice("pairs", i, WINDOW - 1), lambda x: F.struct(F.xxhash64(F.lit(k), x).alias("hash"), x.alias("pair")))).getField("pair"))

    df = pin(df, starts=starts)
    return pin(df, **{f"m{k}": lowest(k) for k in range(BANDS)}).drop("starts", "pairs")


def _shingles(words):
    """Distinct five-word shingles (all words if there are fewer)."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def _prepared(spark: SparkSession, templates) -> list:
    """(name, minima per band, shingles) of each template, by the same expressions as the texts'."""
    df = pin(spark.createDataFrame(templates, "name string, text string"), words=_words(F.col("text")))
    df = pin(df, pairs=_pairs(F.col("words")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("pairs") - WINDOW + 2, F.lit(1)))
    return _with_minima(df, starts).select("name", F.array(*[f"m{k}" for k in range(BANDS)]).alias("minima"),
                     _shingles(F.col("words")).alias("shingles")).collect()  # the parameter's rows


def scan(docs: DataFrame, templates=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_shared, n_template, containment: one row per text and matching template."""
    spark = docs.sparkSession
    known = _prepared(spark, templates or NOTICES)
    src = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    src = pin(src, words=_words(F.col("_text"))).drop("_text")
    src = pin(src.filter(F.size("words") >= 2), pairs=_pairs(F.col("words")))
    # a window shares a band only if it holds the pair that is the template window's
    # minimum there, so the others' minima need not be computed
    telling = sorted({v for t in known for k in range(BANDS) for v in t.minima[k] if v is not None})
    src = pin(src, places=F.array_compact(F.transform("pairs", lambda x, i: F.when(x.isin(telling), i))))

    def windows(p):
        """Starts of the windows that hold pair ``p`` (counted from 0)."""
        last = p - p % STRIDE
        return F.filter(F.array(*[F.when((last >= back) & (p - last + back < WINDOW - 1), last - back + 1)
                                  for back in range(0, WINDOW - 1, STRIDE)]), lambda x: x.isNotNull())

    starts = F.array_distinct(F.flatten(F.transform("places", windows)))
    src = _with_minima(src.filter(F.size("places") > 0), starts).drop("places")

    def hit(values_of_band):
        """Does any window share a band?"""
        found = F.lit(False)
        for k in range(BANDS):
            values = sorted({v for v in values_of_band(k) if v is not None})
            found = found | F.arrays_overlap(f"m{k}", F.array(*[F.lit(v) for v in values]))
        return found

    near = src.filter(hit(lambda k: (v for t in known for v in t.minima[k])))
    candidates = F.filter(F.array(*[F.when(hit(lambda k, t=t: t.minima[k]), F.struct(
        F.lit(t.name).alias("license"), F.array(*[F.lit(s) for s in t.shingles]).alias("shingles"))) for t in known]),
        lambda c: c.isNotNull())
    near = pin(near.select("doc_id", "words", candidates.alias("candidates")).filter(F.size("candidates") > 0),
                shingles=_shingles(F.col("words")))
    verified = F.transform("candidates", lambda c: F.struct(
        c["license"].alias("license"), F.size(F.array_intersect(c["shingles"], F.col("shingles"))).cast("bigint").alias("n_shared"),
        F.size(c["shingles"]).cast("bigint").alias("n_template")))
    return (near.select("doc_id", F.inline(verified)).filter(100 * F.col("n_shared") >= PERCENT * F.col("n_template"))
            .withColumn("containment", F.col("n_shared") / F.col("n_template")))


def sql(templates=None) -> str:
    """The result of ``scan`` over ``documents``, for DuckDB: every text against every template."""
    rows = ", ".join("({})".format(", ".join("'" + v.replace("'", "''") + "'" for v in t)) for t in templates or NOTICES)
    words = ("list_filter([rtrim(w, '.') FOR w IN string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}.+-]+', ' ', 'g'), ' ')], "
             "lambda x: x <> '')")
    shingles = ("list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)])")
    return f"""
WITH templates(license, text) AS (VALUES {rows}),
t AS (SELECT license, {shingles} AS s FROM (SELECT license, {words} AS w FROM templates)),
d AS (SELECT doc_id, {shingles} AS s FROM (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 2),
hits AS (
  SELECT d.doc_id, t.license, CAST(len(list_intersect(t.s, d.s)) AS BIGINT) AS n_shared, CAST(len(t.s) AS BIGINT) AS n_template
  FROM d, t WHERE list_has_any(t.s, d.s)
)
SELECT doc_id, license, n_shared, n_template, n_shared / n_template AS containment
FROM hits WHERE 100 * n_shared >= {PERCENT} * n_template"""
