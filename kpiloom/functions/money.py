"""Ratios, null handling and display formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient as a double, zero where the divisor is zero or NULL."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(quotient, F.lit(0.0))


def format_money(value: Column) -> Column:
    """Two decimals, thousands separated, ties rounded to even."""
    return F.format_number(value, 2)


def format_pct(value: Column) -> Column:
    """One decimal and a percent sign, ties rounded to even."""
    return F.concat(F.call_function("format_number", value, F.lit("0.0")), F.lit("%"))
