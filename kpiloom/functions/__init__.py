"""Column expressions, all composed of JVM-side built-ins."""

from kpiloom.functions.calendar import day_of, partition_date_ist, year_month
from kpiloom.functions.money import format_money, format_pct, safe_ratio, zero_if_null
from kpiloom.functions.parse import parse_iso_date, safe_amount, safe_timestamp, to_order_date
from kpiloom.functions.text import digits_only, null_if_missing, title_case, trim_text

__all__ = [
    "day_of",
    "digits_only",
    "format_money",
    "format_pct",
    "null_if_missing",
    "parse_iso_date",
    "partition_date_ist",
    "safe_amount",
    "safe_ratio",
    "safe_timestamp",
    "title_case",
    "to_order_date",
    "trim_text",
    "year_month",
    "zero_if_null",
]
