"""Row predicates over audit lines (F1-F16).

All are plain Catalyst predicates, so Spark pushes them as far down as the
plan allows and evaluates them in generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column

from .text import ECHO_WORD, INSPECTOR_ROLE, KEYWORD_INSERT, KEYWORD_QUERY, KEYWORD_UPDATE, RECORD_START, col_of


def _any_contains(line: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [line.contains(n) for n in needles])


def _keywords(words, spaced: bool):
    return [f" {w} " if spaced else w for w in words]


def is_record(raw) -> Column:
    """the raw line starts with '['."""
    return col_of(raw).startswith(RECORD_START)


def not_echo(line="line") -> Column:
    """drop echo lines (substring 'INPUT' anywhere)."""
    return ~col_of(line).contains(ECHO_WORD)


def is_write(line="line", spaced: bool = True, extra_markers=()) -> Column:
    """F4a / F4d: INSERT INTO or UPDATE statements (optionally other markers, U2)."""
    words = _keywords([KEYWORD_INSERT, KEYWORD_UPDATE], spaced) + list(extra_markers)
    return _any_contains(col_of(line), words)


def is_statement(line="line", spaced: bool = True) -> Column:
    """QUERY, INSERT INTO or UPDATE statements."""
    return _any_contains(col_of(line), _keywords([KEYWORD_QUERY, KEYWORD_INSERT, KEYWORD_UPDATE], spaced))


def is_read(line="line") -> Column:
    """F4e: spaced QUERY lines."""
    return col_of(line).contains(f" {KEYWORD_QUERY} ")


def has_role(line="line", role: str = INSPECTOR_ROLE) -> Column:
    """lines written by the given role."""
    return col_of(line).contains(role)


def is_numeric(c) -> Column:
    """all-digit case id."""
    return col_of(c).rlike("^[0-9]+$")


def found(c) -> Column:
    """Non-empty extraction result."""
    return col_of(c) != ""
