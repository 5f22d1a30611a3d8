"""Scalar column expressions over audit-log lines.

Every function here takes and returns a ``pyspark.sql.Column`` and is built only
from Catalyst built-ins, so it stays inside whole-stage codegen (no Python row
functions anywhere).  Regular expressions carry the ``(?U)`` flag so that
``\\d``, ``\\s``, ``\\w`` and ``\\b`` follow Unicode rules, as Python's ``re``
does on ``str``; this matters for Greek text and for NBSP (0xA0) in cp1253.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the log format (must stay exactly as written).
# ---------------------------------------------------------------------------
RECORD_START = "["                 # a record line starts with this character
TS_END = "]"                       # the timestamp ends at the first ']'
QUERY_MARKER = "QUERY      : "     # marker before a logged SELECT (six blanks)
ECHO_WORD = "INPUT"                # echo/noise lines contain this word
KEYWORD_QUERY = "QUERY"
KEYWORD_INSERT = "INSERT INTO"
KEYWORD_UPDATE = "UPDATE"
# Greek registration plate: three Greek capitals then four digits.
PLATE_PATTERN = r"([Α-Ω]{3}\d{4})"
# Record id as logged; note ". *?" (one character, then lazily blanks).
RECORD_ID_PATTERN = r"WHERE. *?\bARXEISOD\.ID\s*=\s*(\d+)"
# Same intent with a free gap between WHERE and the id predicate.
RECORD_ID_PATTERN_LOOSE = r"WHERE.*?\bARXEISOD\.ID\s*=\s*(\d+)"
# Table name after INSERT INTO / UPDATE (ASCII names).
TABLE_PATTERN = r"(INSERT INTO|UPDATE)\s+([a-zA-Z0-9_]+)"
# Role of the statements picked by the structure job ("inspector").
INSPECTOR_ROLE = "Ελεγκτης"
# Day-first timestamp text, same grammar as strptime("%d/%m/%Y %H:%M:%S"):
# day, month, hour, minute, second with one or two digits (a single-digit day
# may have a leading blank), a four-digit year other than 0000, blanks
# between date and time.
TS_PATTERN = (r"^(?: (?=[1-9]/))?(3[01]|[12][0-9]|0?[1-9])/(1[0-2]|0?[1-9])/((?!0000)[0-9]{4})"
              r"(?U)\s+(2[0-3]|[01]?[0-9]):([0-5]?[0-9]):([0-5]?[0-9])$")

# Python's str.isspace() set: Unicode White_Space (Java's (?U)\s) plus the
# four separators U+001C..U+001F.
_BLANK = r"[\s\x{1c}-\x{1f}]"
_NUMBER = r"(?U)\b\d+(\.\d+)?\b"
_QUOTED = r"'[^\n]*?'"             # Python's '.*?' (dot stops only at \n)


def _regex_literal(text: str) -> str:
    """Quote ``text`` for use as a Java regular expression (a single plain
    character stays as it is, which keeps Java's no-regex split path)."""
    if len(text) == 1 and text not in ".$|()[]{}^?*+\\":
        return text
    return r"\Q" + text + r"\E"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Record fields
# ---------------------------------------------------------------------------
def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing Unicode blanks.

    The regex only runs on values whose first or last character is a blank."""
    v = col_of(c)
    ends = F.concat(F.substring(v, 1, 1), F.substring(v, -1, 1))
    return F.when(ends.rlike("(?U)" + _BLANK), F.regexp_replace(v, f"(?U)^{_BLANK}+|{_BLANK}+$", "")) \
        .otherwise(v)


def ts_text(line) -> Column:
    """Text between the first character and the first ']' (P1 input)."""
    return F.substring(F.substring_index(col_of(line), TS_END, 1), 2, 1 << 30)


def parse_day_first(text) -> Column:
    """``dd/mm/yyyy HH:MM:SS`` (unpadded accepted) → TIMESTAMP_NTZ, invalid → null.

    One anchored match checks the grammar, the match is rewritten to
    ``yyyy-m-d h:m:s`` and Spark's own string-to-timestamp cast parses it
    (``try_cast`` gives null for impossible dates such as 31/02)."""
    t = col_of(text)
    m = F.regexp_extract(t, TS_PATTERN, 0)
    iso = F.regexp_replace(m, TS_PATTERN, "$3-$2-$1 $4:$5:$6")
    return F.when(m != "", iso.try_cast("timestamp_ntz"))


def token(line, index: int, sep: str = " ") -> Column:
    """``line.split(sep)[index]``; null when the line is shorter."""
    return F.get(F.split(col_of(line), _regex_literal(sep)), F.lit(index))


def case_id(line) -> Column:
    """Third blank-separated token of the line."""
    return token(line, 2)


# ---------------------------------------------------------------------------
# Statement templates
# ---------------------------------------------------------------------------
def _after(line: Column, keyword: str, truncate_repeat: bool) -> Column:
    """``line.split(keyword)[1]``: text between the first and the second
    occurrence (faithful) or the whole remainder (``truncate_repeat=False``);
    null when ``keyword`` does not occur.  Plain string functions, no regex."""
    at = F.instr(line, keyword)
    rest = F.substring(line, at + len(keyword), 1 << 30)
    body = F.substring_index(rest, keyword, 1) if truncate_repeat else rest
    return F.when(at > 0, body)


def strip_literals(body) -> Column:
    """Delete every ':' then replace each quoted literal by '?'."""
    return F.regexp_replace(F.replace(col_of(body), F.lit(":"), F.lit("")), _QUOTED, "?")


def replace_numbers(c) -> Column:
    """Whole-word numbers (``12``, ``1.5``) → ``?`` (P4 step 3, P20)."""
    return F.regexp_replace(col_of(c), _NUMBER, "?")


def squeeze_blanks(c) -> Column:
    """Runs of Unicode blanks → one blank, then strip (P4 step 4, P20)."""
    return F.trim(F.regexp_replace(col_of(c), f"(?U){_BLANK}+", " "))


def statement_body(line, spaced: bool = True, truncate_repeat: bool = True) -> Column:
    """Pick the logged statement (first rule that applies wins):
    contains ``QUERY`` → text after it; contains ``INSERT INTO`` → that keyword
    plus the text after it; otherwise ``UPDATE`` plus the text after it.
    ``spaced`` tests the first two keywords with a trailing blank (P4) or
    without (P19).  Colons are dropped and quoted literals become ``?``."""
    line = col_of(line)
    sp = " " if spaced else ""
    return (
        F.when(line.contains(KEYWORD_QUERY + sp),
               strip_literals(_after(line, KEYWORD_QUERY, truncate_repeat)))
        .when(line.contains(KEYWORD_INSERT + sp),
              F.concat(F.lit(KEYWORD_INSERT + " "),
                       strip_literals(_after(line, KEYWORD_INSERT, truncate_repeat))))
        .otherwise(F.concat(F.lit(KEYWORD_UPDATE + " "),
                            strip_literals(_after(line, KEYWORD_UPDATE, truncate_repeat))))
    )


def normalize_query(line, truncate_repeat: bool = True) -> Column:
    """Literal-free template of a logged statement.

    Lines without a usable statement (null, or no UPDATE in the fallback
    branch) give ``""`` rather than null."""
    body = statement_body(line, spaced=True, truncate_repeat=truncate_repeat)
    return F.coalesce(squeeze_blanks(replace_numbers(body)), F.lit(""))


def light_normalize(line) -> Column:
    """Statement text with literals and colons removed but numbers and blanks
    kept (P19, used by the structure job)."""
    return statement_body(line, spaced=False)


def normalize_condition(c) -> Column:
    """Numbers → ``?`` and blanks squeezed (P20)."""
    return squeeze_blanks(replace_numbers(c))


def before_where(line) -> Column:
    """Text before the first `` WHERE `` (case-sensitive), unchanged if absent (P5)."""
    return F.substring_index(col_of(line), " WHERE ", 1)


def query_text(line) -> Column:
    """Text after the ``QUERY      : `` marker, up to a second marker if any
    (``split(marker)[1]``); null when the marker is absent (P9)."""
    return _after(col_of(line), QUERY_MARKER, truncate_repeat=True)


# ---------------------------------------------------------------------------
# Keys pulled out of lines
# ---------------------------------------------------------------------------
def extract(line, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` (group ``group``), ``""`` when none."""
    return F.regexp_extract(col_of(line), "(?U)" + pattern, group)


def plate(line, pattern: str = PLATE_PATTERN) -> Column:
    return extract(line, pattern, 1)


def record_id(line, pattern: str = RECORD_ID_PATTERN) -> Column:
    return extract(line, pattern, 1)


def table_name(line, pattern: str = TABLE_PATTERN) -> Column:
    return F.regexp_extract(col_of(line), pattern, 2)


# ---------------------------------------------------------------------------
# labels
# ---------------------------------------------------------------------------
def time_of_day(ts) -> Column:
    """``HH:mm:ss`` of a timestamp."""
    return F.date_format(col_of(ts), "HH:mm:ss")


def confidence_label(c) -> Column:
    """Two-decimal confidence label (P13); Spark rounds half up."""
    return F.format_string("%.2f", col_of(c))


def statement_kind(query) -> Column:
    """``read`` if the text contains SELECT, else ``insert`` if INSERT, else ``write``."""
    q = col_of(query)
    return (F.when(q.contains("SELECT"), F.lit("read"))
            .when(q.contains("INSERT"), F.lit("insert"))
            .otherwise(F.lit("write")))
