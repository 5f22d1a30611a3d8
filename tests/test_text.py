"""Scalar expressions against hand-derived expectations."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from qtrail.functions import text as T

PFX = "[10/12/2024 08:00:00] 5 Ελεγκτης "


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("line,expected", [
    (PFX + "QUERY      : SELECT A FROM T WHERE X = 'abc' AND Y = 12", "SELECT A FROM T WHERE X = ? AND Y = ?"),
    (PFX + "QUERY      : SELECT QUERY_ID FROM T", "SELECT"),
    (PFX + "TRANSACTION: UPDATE T SET LAST_UPDATE = 5", "UPDATE T SET LAST_"),
    (PFX + "QUERY      : SELECT 1.5, 1.2.3, -5, T_1, a1, 12α, ΑΒΓ1234 FROM X",
     "SELECT ?, ?.?, -?, T_1, a1, 12α, ΑΒΓ1234 FROM X"),
    (PFX + "QUERY      : SELECT A FROM T WHERE N = ١٢", "SELECT A FROM T WHERE N = ?"),
    (PFX + "QUERY      : SELECT A FROM T WHERE S = 'it''s'", "SELECT A FROM T WHERE S = ??"),
    (PFX + "QUERY      : SELECT A FROM T WHERE A = :p AND B::int", "SELECT A FROM T WHERE A = p AND Bint"),
    (PFX + "QUERY      : SELECT A FROM T WHERE AT = 08:00:00", "SELECT A FROM T WHERE AT = ?"),
    (PFX + "TRANSACTION: INSERT INTO T (A,B) VALUES (1,'x')", "INSERT INTO T (A,B) VALUES (?,?)"),
    (PFX + "QUERY      : SELECT A\tFROM  T\x1cX  ", "SELECT A FROM T X"),
    (PFX + "QUERY      : INSERT INTO T VALUES (1)", "INSERT INTO T VALUES (?)"),
    ("hello world", ""),
    (None, ""),
])
def test_normalize_query(spark, line, expected):
    assert one(spark, T.normalize_query, line) == expected


def test_normalize_query_keep_remainder(spark):
    line = PFX + "QUERY      : SELECT QUERY_ID FROM T"
    assert one(spark, lambda c: T.normalize_query(c, truncate_repeat=False), line) == "SELECT QUERY_ID FROM T"


def test_light_normalize_keeps_numbers(spark):
    assert one(spark, T.light_normalize, PFX + "QUERY : SELECT A FROM T WHERE  X='q' AND Y=12") == \
        "  SELECT A FROM T WHERE  X=? AND Y=12"


@pytest.mark.parametrize("text,expected", [
    ("10/12/2024 08:00:00", dt.datetime(2024, 12, 10, 8, 0, 0)),
    ("1/2/2024 8:0:0", dt.datetime(2024, 2, 1, 8, 0, 0)),
    ("31/02/2024 00:00:00", None),
    ("10/12/2024 24:00:00", None),
    ("10/12/2024 08:00:60", None),
    ("10/12/24 08:00:00", None),
    ("x", None),
    (None, None),
])
def test_parse_day_first(spark, text, expected):
    assert one(spark, T.parse_day_first, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("\t a b \r", "a b"), (" x\u0085", "x"), ("\x1fy\x1c", "y"), ("z", "z"), ("  ", ""),
])
def test_py_strip(spark, text, expected):
    assert one(spark, T.py_strip, text) == expected == text.strip()


def test_case_id(spark):
    assert one(spark, T.case_id, PFX + "QUERY : X") == "5"
    assert one(spark, T.case_id, "[10/12/2024 08:00:00]") is None


@pytest.mark.parametrize("line,expected", [
    ("WHERE P = 'ΑΒΓ12345'", "ΑΒΓ1234"), ("WHERE P = 'ABC1234'", ""), ("ΧΨΩ0001 x", "ΧΨΩ0001"),
])
def test_plate(spark, line, expected):
    assert one(spark, T.plate, line) == expected


@pytest.mark.parametrize("line,expected", [
    ("SELECT * FROM ARXEISOD WHERE ARXEISOD.ID = 5", "5"),
    ("SELECT * FROM ARXEISOD WHERE (ARXEISOD.ID = 5)", ""),
    ("SELECT * FROM ARXEISOD WHERE A=1 AND ARXEISOD.ID=7", ""),
    ("SELECT * FROM ARXEISOD WHERE  ARXEISOD.ID=42 AND B=1", "42"),
])
def test_record_id(spark, line, expected):
    assert one(spark, T.record_id, line) == expected


def test_record_id_loose(spark):
    assert one(spark, lambda c: T.record_id(c, T.RECORD_ID_PATTERN_LOOSE),
               "SELECT * FROM ARXEISOD WHERE A=1 AND ARXEISOD.ID=7") == "7"


def test_before_where_and_table_and_query_text(spark):
    assert one(spark, T.before_where, "SELECT A FROM T WHERE X WHERE Y") == "SELECT A FROM T"
    assert one(spark, T.before_where, "SELECT A FROM T") == "SELECT A FROM T"
    assert one(spark, T.table_name, "x INSERT INTO  T_1.X VALUES") == "T_1"
    assert one(spark, T.table_name, "x DELETE FROM T") == ""
    assert one(spark, T.query_text, "[..] QUERY      : SELECT A") == "SELECT A"
    assert one(spark, T.query_text, "[..] no marker") is None


def test_labels(spark):
    assert one(spark, T.statement_kind, "SELECT A") == "read"
    assert one(spark, T.statement_kind, "INSERT INTO T") == "insert"
    assert one(spark, T.statement_kind, "UPDATE T") == "write"
    assert one(spark, T.confidence_label, 0.3333, "v double") == "0.33"
    assert one(spark, T.time_of_day, dt.datetime(2024, 1, 2, 3, 4, 5), "v timestamp_ntz") == "03:04:05"
