"""Audit log rendered from the driver's ``events`` table.

The reference's input log is not public, so the engine is exercised on a log
that Spark derives line by line from ``events`` (one line per event, same
format as the audit log).  File order is ``event_id`` order; ``block`` groups
``2**14`` consecutive ids, so blocks are bounded in size whatever the skew of
users or time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The rendered line format (see FIXTURES.md, "Rendered log").
LINE_PREFIX_TS = "dd/MM/yyyy HH:mm:ss"
ROLE = "user"
BODIES = {
    "view": "QUERY      : SELECT ID,NAME FROM ITEMS%s WHERE PLATE='ABC%07d' AND ID = %d",
    "click": "QUERY      : SELECT COUNT(ID) FROM CLICKS%s C LEFT OUTER JOIN ITEMS%s I ON (C.ITEM_ID=I.ID) "
             "WHERE (C.USER_ID = %d) AND (C.FLAG = 'T')",
    "signup": "TRANSACTION: INSERT INTO USERS%s (ID,NAME) VALUES (%d,'u:x')",
    "purchase": "TRANSACTION: UPDATE ORDERS%s SET TOTAL = 1.5 WHERE ORDERS.ID = %d",
    "error": "INPUT      : QUERY ignored %d",
}
OTHER_BODY = "INPUT      : OTHER %d"
# What fills each placeholder of the body, in order.
BODY_ARGS = {
    "view": ("shape", "user", "event_id"),
    "click": ("shape", "shape", "user"),
    "signup": ("shape", "user"),
    "purchase": ("shape", "record"),
    "error": ("event_id",),
}
BLOCK_BITS = 14
# The shape of a statement: an era (4,096 events, so that templates of two eras
# follow each other at era ends only) and a number s with P(s or more) = 1/s, by
# a multiplicative hash of the event id: a few frequent templates, a long tail.
ERA_BITS = 12
SHAPE_PRIME, SHAPE_FACTOR = 1_000_003, 7919
# every 50th view is logged twice; every 11th line ends in blanks; 20 ids share a record
REPEAT_EVERY, BLANK_EVERY, RECORD_SPAN = 50, 11, 20
# Patterns that fit the rendered log (ASCII plates of seven digits or more, ORDERS ids).
RENDERED_PLATE_PATTERN = r"([A-Z]{3}\d{7,})"
RENDERED_RECORD_ID_PATTERN = r"WHERE. *?\bORDERS\.ID\s*=\s*(\d+)"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def render_events(events: DataFrame) -> DataFrame:
    """events → raw log lines (seq, block, value); ``seq`` is twice the event id
    (a repeated line has the odd number).  Other event types give echo lines, a
    null user is user 0."""
    from ..session import spread
    src = spread(events.select("event_id", "ts", "user_id", "event_type"))
    hashed = (F.col("event_id") % SHAPE_PRIME) * SHAPE_FACTOR % SHAPE_PRIME
    number = F.floor(F.lit(SHAPE_PRIME) / (hashed + 1)).cast("bigint")
    era = F.when(F.shiftright("event_id", ERA_BITS).bitwiseAND(1) == 0, "A").otherwise("B")
    args = {"shape": F.concat(era, number.cast("string")), "user": F.coalesce("user_id", F.lit(0)).cast("bigint"),
            "event_id": F.col("event_id"), "record": F.floor(F.col("event_id") / RECORD_SPAN).cast("bigint")}
    body = None
    for kind, fmt in BODIES.items():
        text = F.format_string(fmt, *[args[c] for c in BODY_ARGS[kind]])
        body = (F.when(F.col("event_type") == kind, text) if body is None
                else body.when(F.col("event_type") == kind, text))
    body = body.otherwise(F.format_string(OTHER_BODY, F.col("event_id")))
    blanks = F.when(F.col("event_id") % BLANK_EVERY == 0, "  ").otherwise("")
    value = F.concat(F.lit("["), F.date_format("ts", LINE_PREFIX_TS), F.lit("] "),
                     args["user"].cast("string"), F.lit(f" {ROLE} "), body, blanks)
    place = (F.col("event_id") * 2).cast("bigint")
    twice = (F.col("event_type") == "view") & (F.col("event_id") % REPEAT_EVERY == 0)
    return src.select(
        F.explode(F.when(twice, F.array(place, place + 1)).otherwise(F.array(place))).alias("seq"),
        F.shiftright(F.col("event_id"), BLOCK_BITS).alias("block"),
        value.alias("value"),
    )


def rendered_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_events(load_table(spark, sf_dir, "events"))


def rendered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered event table (seq, block, ts, line) of the rendered log."""
    from .auditlog import parse_audit_lines
    return parse_audit_lines(rendered_raw(spark, sf_dir))
