"""Column expressions (P*) and predicates (F*) for audit-log lines."""

from . import predicates, text
from .text import (
    before_where,
    case_id,
    confidence_label,
    light_normalize,
    normalize_condition,
    normalize_query,
    parse_day_first,
    plate,
    py_strip,
    query_text,
    record_id,
    statement_kind,
    table_name,
    time_of_day,
)

__all__ = [
    "predicates", "text", "before_where", "case_id", "confidence_label", "light_normalize",
    "normalize_condition", "normalize_query", "parse_day_first", "plate", "py_strip", "query_text",
    "record_id", "statement_kind", "table_name", "time_of_day",
]
