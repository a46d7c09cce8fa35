"""Column expressions."""

from .columns import (
    NULL_TOKENS,
    day_text,
    normalize_name,
    normalized_names,
    null_if_token,
    number_text,
    parse_date,
    parse_engagements,
    percent_text,
    quoted,
    sql_name,
    sql_text,
    whole_text,
)

__all__ = [
    "NULL_TOKENS",
    "day_text",
    "normalize_name",
    "normalized_names",
    "null_if_token",
    "number_text",
    "parse_date",
    "parse_engagements",
    "percent_text",
    "quoted",
    "sql_name",
    "sql_text",
    "whole_text",
]
