"""Calendar buckets."""

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The zone whose date names a landing folder, and the month label.
LANDING_ZONE = "Asia/Kolkata"
MONTH_FORMAT = "yyyy-MM"


def utc_moment(moment: datetime) -> datetime:
    """The same moment without a zone, in UTC; one without a zone is UTC already."""
    return moment if moment.tzinfo is None else moment.astimezone(UTC).replace(tzinfo=None)


def year_month(moment: Column) -> Column:
    return F.date_format(moment, MONTH_FORMAT)


def day_of(moment: Column) -> Column:
    return F.to_date(moment)


def partition_date_ist(utc: Column) -> Column:
    """The date in India of a zone-less UTC timestamp."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(LANDING_ZONE), utc))
