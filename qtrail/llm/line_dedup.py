"""Operator 9: line dedup by overlapping three-line windows (DataFrame functions only).

Every run of ``WINDOW`` consecutive lines of every text is hashed (two 64-bit
hashes of its lines).  A window seen at several places stays at its first place,
by (doc_id, row hash, line), and its later occurrences mark the lines they cover;
marked lines are merged and removed.  Lines are split at line feeds and
compared as they are.

Windows travel as hashes: the texts are shuffled once, for the join with their
own marked lines (a merge join at every size: the marked lines grow with the data).  A window that a third of all rows share is one row per task
after partial aggregation; its first place is written before it is joined back,
so the skew rule can split its occurrences.

Defined results: null texts stay null, texts of fewer lines than a window and
windows of blank lines only are left alone; a text whose lines are all covered
becomes empty; equal rows (same id, same text) are one occurrence, so they stay
equal; a null id sorts first; an empty table gives no row; all other columns
are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_stored, pin, stored

WINDOW = 3


def _windows(lines: DataFrame) -> DataFrame:
    """(_ld_id, _ld_k1, _ld_k2, line, h1, h2) of every window of ``_ld_lines`` that is not blank."""
    each = pin(lines, first=F.transform("_ld_lines", lambda x: F.xxhash64(x)),
               second=F.transform("_ld_lines", lambda x: F.xxhash64(F.lit(9), x)),
               blank=F.transform("_ld_lines", lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) == "")).drop("_ld_lines")

    def at(i):
        empty = F.lit(True)
        for k in range(WINDOW):
            empty = empty & F.get("blank", i + k)
        return F.struct(i.alias("line"), F.xxhash64(*[F.get("first", i + k) for k in range(WINDOW)]).alias("h1"),
                        F.xxhash64(*[F.get("second", i + k) for k in range(WINDOW)]).alias("h2"), empty.alias("blank"))

    found = F.transform(F.sequence(F.lit(0), F.size("first") - WINDOW), at)
    return each.select("_ld_id", "_ld_k1", "_ld_k2", F.inline(F.filter(found, lambda w: ~w["blank"]))).drop("blank")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", figures: bool = True) -> DataFrame:
    """``docs`` with ``text_col`` cleaned and, with ``figures``, the columns ``n_lines``
    and ``n_removed`` added (in place of columns of these names).

    Runs jobs while it is built."""
    key = [F.xxhash64(F.col(id_col), F.col(text_col)).alias("_ld_k1"), F.xxhash64(F.lit(3), F.col(id_col), F.col(text_col)).alias("_ld_k2")]
    lines = docs.filter(F.col(text_col).contains("\n")).select(F.col(id_col).alias("_ld_id"), *key, F.split(text_col, "\n").alias("_ld_lines"))
    windows, scratch = stored(_windows(lines.filter(F.size("_ld_lines") >= WINDOW)), "windows")
    place = F.struct("_ld_id", "_ld_k1", "_ld_k2", "line")
    repeated = (windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                .filter(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"))
    repeated, more = stored(repeated, "repeated-windows")
    later = windows.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("_ld_k1", "_ld_k2").agg(F.collect_set("line").alias("_ld_starts"))  # a text's own lines at most
    covered, _ = stored(covered, "covered-lines")
    drop_stored(docs.sparkSession, scratch, more)
    out = docs.withColumns({"_ld_k1": key[0], "_ld_k2": key[1]}).join(covered.hint("merge"), ["_ld_k1", "_ld_k2"], "left")
    out = pin(out, _ld_lines=F.split(text_col, "\n"),
              _ld_marked=F.array_distinct(F.flatten(F.transform("_ld_starts", lambda s: F.sequence(s, s + WINDOW - 1)))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), F.col("_ld_marked"))
    if figures:
        out = out.withColumns({"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_ld_lines")).cast("bigint"),
                               "n_removed": F.coalesce(F.size("_ld_marked"), F.lit(0)).cast("bigint")})
    cleaned = F.array_join(F.transform(left, lambda i: F.get("_ld_lines", i)), "\n")
    return (out.withColumn(text_col, F.when(F.col("_ld_starts").isNull(), F.col(text_col)).otherwise(cleaned))
            .drop("_ld_k1", "_ld_k2", "_ld_starts", "_ld_lines", "_ld_marked"))


#: the result of the thin query, for DuckDB
SQL = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), windows AS (
  SELECT DISTINCT doc_id, text, i, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c
  FROM (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS i FROM lines WHERE len(l) >= 3)
), later AS (
  SELECT doc_id, text, i FROM windows
  WHERE trim(concat(a, b, c), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''
  QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) > 1
), covered AS (
  SELECT doc_id, text, list_distinct(flatten(list([i, i + 1, i + 2]))) AS gone FROM later GROUP BY doc_id, text
), cleaned AS (
  SELECT d.doc_id, coalesce(len(d.l), 0) AS n_lines, coalesce(len(c.gone), 0) AS n_removed,
         CASE WHEN c.gone IS NULL THEN d.text
              ELSE array_to_string([x FOR x, k IN d.l IF NOT list_contains(c.gone, k)], chr(10)) END AS text
  FROM lines d LEFT JOIN covered c ON d.doc_id = c.doc_id AND d.text = c.text
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(length(text) AS BIGINT) AS n_chars_left, md5(text) AS text_md5
FROM cleaned"""
