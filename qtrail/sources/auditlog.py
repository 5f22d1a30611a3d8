"""Audit-log sources.

The scan is distributed: ``spark.read.text`` splits files into blocks, every
line keeps its raw bytes (Spark's text source does not validate UTF-8), and a
single-byte code page is decoded with a ``decode``/``translate`` pair built
from Python's codec.  No legacy charset settings are needed.

Every log row carries

* ``seq``   – an orderable key equal to file order
  (``struct(file, block_start, row)``; files in path order),
* ``block`` – the input block the line came from, monotone in ``seq`` and
  bounded in size by ``spark.sql.files.maxPartitionBytes``.  Order-dependent
  operators (successor, dense position) work per block and stitch blocks, so
  no operator ever needs a single-partition global window over the events.
"""

from __future__ import annotations

import codecs
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..session import spread

DEFAULT_CODEPAGE = "windows-1253"
LOG_COLUMNS = ["seq", "block", "ts", "line"]


@lru_cache(maxsize=None)
def codepage_table(codepage: str) -> tuple[str, str]:
    """Characters a single-byte code page maps differently from ISO-8859-1.

    Returns (latin1_chars, codepage_chars) for ``translate``; undefined bytes
    become U+FFFD like ``errors="replace"``."""
    raw = bytes(range(256))
    latin = raw.decode("latin-1")
    target = raw.decode(codepage, errors="replace")
    if len(target) != 256:
        raise ValueError(f"{codepage} is not a single-byte code page")
    pairs = [(a, b) for a, b in zip(latin, target) if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def decode_codepage(value: Column, codepage: str | None) -> Column:
    """Decode the raw bytes of a text line in ``codepage`` (None/utf-8: as is)."""
    if codepage is None or codecs.lookup(codepage).name == "utf-8":
        return value
    src, dst = codepage_table(codecs.lookup(codepage).name)
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.translate(latin, src, dst) if src else latin


def parse_audit_lines(raw: DataFrame, value: str = "value") -> DataFrame:
    """Raw lines (seq, block, value) → ordered event table (seq, block, ts, line).

    Keeps record lines (first char '['), parses the day-first timestamp
    between '[' and the first ']' (invalid → row dropped) and strips Unicode
    blanks (F1, F2, P1, P2).  A record line is never blank after stripping
    (it starts with '['), so F2's empty-line test is implied.

    The timestamp test is applied by exploding a zero-or-one element array
    rather than by a Filter: a Filter would be pushed below the projection
    and evaluate the parse (and the expression producing ``value``) again."""
    v = F.col(value)
    parsed = (raw.filter(P.is_record(v))
              .select("seq", "block", F.struct(T.parse_day_first(T.ts_text(v)).alias("ts"),
                                               T.py_strip(v).alias("line")).alias("_r")))
    kept = F.explode(F.when(F.col("_r.ts").isNotNull(), F.array("_r"))).alias("_k")
    return parsed.select("seq", "block", kept).select("seq", "block", "_k.ts", "_k.line")


def encode_codepage(value: Column, codepage: str | None) -> Column:
    """Text as the raw bytes of ``codepage`` (in a string column, as a text sink writes it);
    characters that the code page lacks become ``?``."""
    if codepage is None or codecs.lookup(codepage).name == "utf-8":
        return value
    latin, chars = codepage_table(codecs.lookup(codepage).name)
    own = [(c, b) for c, b in zip(chars, latin) if c != "\ufffd"]
    # a latin character that the code page puts elsewhere, or not at all, has no byte of its own
    gone = "".join(sorted(set(latin) - {c for c, _ in own}))
    named = F.translate(value, "".join(c for c, _ in own) + gone, "".join(b for _, b in own) + "?" * len(gone))
    return F.encode(F.regexp_replace(named, r"[^\x{0}-\x{FF}]", "?"), "ISO-8859-1").cast("string")


def split_reader(spark: SparkSession, split_bytes: int | None):
    """A reader that cuts files into splits of at most ``split_bytes``; the setting is that of
    a session of its own, the caller's stays as it is."""
    if split_bytes is None:
        return spark.read
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    return own.read


def read_raw_lines(spark: SparkSession, paths, codepage: str | None = DEFAULT_CODEPAGE, split_bytes: int | None = None,
                   separator: str | None = None) -> DataFrame:
    """Distributed text scan keeping file order in ``seq`` and the block in ``block``.

    Order comes from the path, the first byte of the split and the line's place in it, so
    any number of tasks may read a file.  ``split_bytes``: see ``split_reader``;
    ``separator``: what ends a line, in place of line breaks."""
    if isinstance(paths, str):
        paths = [paths]
    reader = split_reader(spark, split_bytes)
    df = (reader if separator is None else reader.option("lineSep", separator)).text(list(paths))
    f = F.col("_metadata.file_path")
    b = F.col("_metadata.file_block_start")
    lines = df.select(
        F.struct(f.alias("file"), b.alias("start"), F.monotonically_increasing_id().alias("row")).alias("seq"),
        F.struct(f.alias("file"), b.alias("start")).alias("block"),
        F.col("value"),
    )
    # seq is fixed above, in file order; only then may rows move between tasks
    return spread(lines).withColumn("value", decode_codepage(F.col("value"), codepage))


def read_audit_log(spark: SparkSession, paths, codepage: str | None = DEFAULT_CODEPAGE, split_bytes: int | None = None) -> DataFrame:
    """Audit log file(s) → (seq, block, ts TIMESTAMP_NTZ, line)."""
    return parse_audit_lines(read_raw_lines(spark, paths, codepage, split_bytes))


def statement_lines(raw: DataFrame, role: str = T.INSPECTOR_ROLE, value: str = "value") -> DataFrame:
    """Statement lines of one role, lightly normalised.

    Keeps raw lines that contain ``role``, start with '[' and contain one of
    QUERY / INSERT INTO / UPDATE (unspaced); no timestamp parse and no echo
    exclusion, as the structure job expects."""
    v = F.col(value)
    return (raw.filter(P.has_role(v, role) & P.is_record(v) & P.is_statement(v, spaced=False))
            .select("seq", "block", T.light_normalize(v).alias("line")))


def read_statement_lines(spark: SparkSession, paths, role: str = T.INSPECTOR_ROLE,
                         codepage: str | None = DEFAULT_CODEPAGE, split_bytes: int | None = None) -> DataFrame:
    return statement_lines(read_raw_lines(spark, paths, codepage, split_bytes), role)
