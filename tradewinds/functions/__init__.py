"""Column-level building blocks. Everything here maps Column -> Column and stays JVM-side."""

from tradewinds.functions.ratios import percent, safe_ratio, to_flag
from tradewinds.functions.text import clean_text, is_blank, is_digits, joined_label, null_if_blank, text_bytes
from tradewinds.functions.timeparts import (
    calendar_attributes,
    calendar_parts,
    date_key,
    is_unparseable_ts,
    lead_days,
    month_index,
    month_label,
    month_label_of_index,
    month_label_of_key,
    month_offset,
    parse_ts,
    whole_minutes_between,
)

__all__ = [
    "calendar_attributes",
    "calendar_parts",
    "clean_text",
    "date_key",
    "is_blank",
    "is_digits",
    "is_unparseable_ts",
    "joined_label",
    "lead_days",
    "month_index",
    "month_label",
    "month_label_of_index",
    "month_label_of_key",
    "month_offset",
    "null_if_blank",
    "parse_ts",
    "percent",
    "safe_ratio",
    "text_bytes",
    "to_flag",
    "whole_minutes_between",
]
