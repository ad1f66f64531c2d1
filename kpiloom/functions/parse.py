"""Text to typed values, NULL (or zero) where the text does not parse."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiloom.schemas import MONEY


# The first and the last second that a nanosecond timestamp holds.
FIRST_MOMENT = "1677-09-21 00:12:44"
LAST_MOMENT = "2262-04-11 23:47:16"

# A number as text; what looks otherwise is no amount.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def safe_timestamp(text: Column) -> Column:
    """ISO date or date-time to a zone-less timestamp, NULL on failure.

    A moment outside the range of nanosecond timestamps counts as a failure, so
    one stray year does not stretch every calendar figure.
    """
    moment = text.try_cast("timestamp_ntz")
    first, last = (F.lit(t).cast("timestamp_ntz") for t in (FIRST_MOMENT, LAST_MOMENT))
    return F.when(moment.between(first, last), moment)


def safe_amount(text: Column) -> Column:
    """Number to money; what is missing or is no number counts as zero.

    A number too large for the money type is an error: it must not count as
    zero.  The cast goes straight to decimal: by way of double, Spark would also
    take suffixed literals such as ``1.0d``.
    """
    amount, written = text.try_cast(MONEY), text.cast("string")
    too_large = F.raise_error(F.concat(F.lit("amount out of range: "), written)).cast(MONEY)
    missing = F.when(written.rlike(_NUMBER), too_large).otherwise(F.lit(0).cast(MONEY))
    return F.when(amount.isNotNull(), amount).otherwise(missing)


def to_order_date(moment: Column) -> Column:
    return F.to_date(moment)


def parse_iso_date(text: Column) -> Column:
    """ISO date or date-time text to a date, NULL on failure."""
    return text.try_cast("date")
