"""Readers of intermediate results (S3, S4) with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..operators.ordering import with_position, with_running
from ..operators.skew import written
from .auditlog import read_raw_lines, split_reader

EDGE_SCHEMA = Ty.StructType([
    Ty.StructField("normalized_query", Ty.StringType()),
    Ty.StructField("next_query", Ty.StringType()),
    Ty.StructField("count", Ty.LongType()),
    Ty.StructField("total_count", Ty.LongType()),
    Ty.StructField("confidence", Ty.DoubleType()),
])

TRACE_ITEM = Ty.StructType([
    Ty.StructField("timestamp", Ty.StringType()),
    Ty.StructField("normalized_line", Ty.StringType()),
])


def trace_schema(key: str = "entity") -> Ty.StructType:
    return Ty.StructType([
        Ty.StructField(key, Ty.StringType()),
        Ty.StructField("query_count", Ty.LongType()),
        Ty.StructField("chunk", Ty.LongType()),
        Ty.StructField("grouped_lines", Ty.ArrayType(TRACE_ITEM)),
    ])


def read_edge_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: a confidence edge table written as CSV with header.

    Columns are found by their names in the header, in any order; one that the
    file lacks is null, one that it has besides is ignored.  A value that does not
    fit its type raises."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return raw.select(*[_typed(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None).cast("string"), f.dataType, f.name)
                        for f in EDGE_SCHEMA.fields])


def read_rows_in_order(spark: SparkSession, path: str, schema: str, split_bytes: int | None = None) -> DataFrame:
    """Rows of a written CSV folder with their place in it (``pos``, from 0): what a sorted output shows.
    Every file has a header; no value holds a line break."""
    lines = read_raw_lines(spark, path, None, split_bytes)
    names = Ty.StructType.fromDDL(schema).fieldNames()
    body = lines.filter(F.col("value") != ",".join(names))
    parsed = body.select("seq", "block", F.from_csv("value", F.lit(schema), {"escape": '"'}).alias("_r"))
    return with_position(parsed, order=["seq"], block="block", name="pos").select("pos", "_r.*")


def _typed(text: Column, dtype: Ty.DataType, name: str) -> Column:
    if isinstance(dtype, Ty.StringType):
        return text.alias(name)
    value = text.try_cast(dtype)
    return _checked(text, value, name).alias(name)


def _checked(text: Column, value: Column, name: str) -> Column:
    """``value``, or an error where a text has none."""
    bad = F.raise_error(F.concat(F.lit(f"{name}: cannot read "), text))
    return F.when(text.isNotNull() & value.isNull(), bad).otherwise(value)


def wall_time(text: Column) -> Column:
    """The local wall time of a timestamp text, with or without a zone (cut off)."""
    local = F.regexp_replace(text, r"\s*(Z|[+-]\d{2}:?\d{2})$", "")
    return _checked(text, local.try_cast(Ty.TimestampNTZType()), "timestamp")


def array_records(spark: SparkSession, paths, split_bytes: int | None = None) -> DataFrame:
    """The objects of JSON array files, one row ``(file, record, text)`` each, numbered from 0 in a file.

    A bracket-depth scan over byte ranges, so that several tasks read a file however its
    array is laid out (``multiLine`` reads a file in one task).  The text is cut behind
    every ``}``.  Whether a piece starts inside a string is the parity of the quotes before
    it, its depth the sum of the brackets outside strings before it: two running sums, the
    second over the brackets that the first says are real.  An object of the array ends
    where the depth comes back to 1; the number of such ends before a piece is its record.
    No escape spans a cut, as ``\\}`` is none.  Elements that are not objects are left out."""
    raw = read_raw_lines(spark, paths, None, split_bytes, separator="}")
    plain = F.regexp_replace("value", r"\\.", "")  # without escapes: every quote left opens or closes a string
    outside = lambda text: F.regexp_replace(text, '"[^"]*("|$)', "")
    count = lambda text, what: F.length(F.regexp_replace(text, f"[^{what}]", ""))
    depth = lambda text: count(text, r"\{\[") - count(text, r"\}\]")
    quotes = count(plain, '"')
    cut = raw.select("seq", "block", "value", quotes.alias("_quotes"),
                     *[(depth(outside(F.concat(F.lit('"' * start), plain))) - F.when((quotes + start) % 2 == 0, 1).otherwise(0)).alias(f"_from{start}")
                       for start in (0, 1)])
    file = F.col("block.file")
    parity = with_running(cut, {"_q": F.col("_quotes")}, ["seq"], "block", file)
    inside = F.col("_q") % 2 == 1
    turn = F.when(inside, F.col("_from1")).otherwise(F.col("_from0"))
    closes = (F.col("_q") + F.col("_quotes")) % 2 == 0  # its end, the cut bracket, stands outside strings
    deep = with_running(parity.select("seq", "block", "value", turn.alias("_turn"), closes.alias("_closes")), {"_depth": F.col("_turn")}, ["seq"], "block", file)
    ends = F.col("_closes") & (F.col("_depth") + F.col("_turn") == 1)
    placed = with_running(deep.select("seq", "block", "value", ends.alias("_ends"), (F.col("_depth") <= 1).alias("_starts")),
                          {"record": F.col("_ends").cast("int")}, ["seq"], "block", file)
    whole = (placed.groupBy(file.alias("file"), "record")
             .agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("_parts"), F.max("_ends").alias("_done")))  # one object
    text = F.concat(F.array_join(F.transform("_parts", lambda p: p["value"]), "}"), F.lit("}"))
    return whole.filter("_done").select("file", "record", F.regexp_replace(text, r"^[^{]*", "").alias("text"))


def read_trace_json(spark: SparkSession, path: str, key: str = "entity", array: bool = False, split_bytes: int | None = None) -> DataFrame:
    """Nested traces.  ``array=True`` reads JSON array files (the reference's layout),
    in splits (``array_records``); the default reads JSON Lines (ours)."""
    if array:
        parsed = array_records(spark, path, split_bytes).select(F.from_json("text", trace_schema(key)).alias("_r"))
        raw = parsed.select("_r.*")
    else:
        raw = split_reader(spark, split_bytes).schema(trace_schema(key)).json(path)
    return raw.withColumn("grouped_lines", F.transform("grouped_lines", lambda x: F.struct(
        wall_time(x["timestamp"]).alias("timestamp"), x["normalized_line"].alias("normalized_line"))))


def flatten_traces(nested: DataFrame, key: str = "entity") -> DataFrame:
    """Nested traces → flat ``(entity, pos, ts, seq, normalized_line)``.

    Events are re-ordered by timestamp (ties by their place in the file), as
    the trace reader of the reference does; positions per entity are
    computed as in ``ordering.with_position``."""
    items = nested.select(F.col(key).alias("entity"), F.coalesce("chunk", F.lit(0)).alias("_chunk"),
                          F.posexplode("grouped_lines").alias("_i", "_item"))
    flat = items.select("entity", F.col("_item.timestamp").alias("ts"),
                        F.struct("_chunk", "_i").alias("seq"),
                        F.col("_item.normalized_line").alias("normalized_line"))
    flat, heavy = written(flat, ["entity"], "flat-traces")
    return with_position(flat, order=["ts", "seq"], partition_by=["entity"], name="pos", heavy=heavy).select("entity", "pos", "ts", "seq", "normalized_line")
