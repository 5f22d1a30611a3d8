"""The line-local part of the audit-log scan on a file stream.

Decoding, record filtering, timestamp parsing, templates and per-template or
per-entity counts depend on one line only, so they run unchanged on
``readStream.text``.  Order-dependent operators (successor pairs, first query
per case, traces) need the whole ordered log and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..sources.auditlog import DEFAULT_CODEPAGE, decode_codepage


def stream_audit_log(spark: SparkSession, directory: str, codepage: str | None = DEFAULT_CODEPAGE,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (ts, line) rows from new log files arriving in ``directory``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(directory).select(decode_codepage(F.col("value"), codepage).alias("value"))
    v = F.col("value")
    return (raw.filter(P.is_record(v))
            .select(T.parse_day_first(T.ts_text(v)).alias("ts"), T.py_strip(v).alias("line"))
            .filter(F.col("ts").isNotNull() & (F.col("line") != "")))


def stream_template_counts(log: DataFrame) -> DataFrame:
    """A3 on a stream: running count per template (complete/update output mode)."""
    return (log.filter(P.not_echo("line") & P.is_statement("line", spaced=True))
            .select(T.normalize_query("line").alias("normalized_query"))
            .filter(P.found("normalized_query"))
            .groupBy("normalized_query").agg(F.count(F.lit(1)).alias("count")))


def stream_entity_counts(log: DataFrame, pattern: str = T.PLATE_PATTERN) -> DataFrame:
    """A5 on a stream: running count of read statements per entity."""
    return (log.filter(P.not_echo("line") & P.is_read("line"))
            .select(T.plate("line", pattern).alias("entity"))
            .filter(P.found("entity"))
            .groupBy("entity").agg(F.count(F.lit(1)).alias("count")))
