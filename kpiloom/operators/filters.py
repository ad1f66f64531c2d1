"""Filters, projections and column resolution."""

from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions import safe_amount
from kpiloom.functions.calendar import utc_moment
from kpiloom.schemas import MONEY


def require_columns(df: DataFrame, required: Iterable[str], dataset: str) -> DataFrame:
    """``df`` itself, or an error that names every column it lacks."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"{dataset} lacks required column(s): {', '.join(missing)}")
    return df


def _present(*names: str) -> Column:
    """All named columns hold a value; unlike ``na.drop`` this reaches the scan."""
    return reduce(and_, [F.col(name).isNotNull() for name in names])


def drop_null_customer_keys(customers: DataFrame) -> DataFrame:
    return customers.filter(_present("customer_id", "mobile_number"))


def drop_null_order_keys(lines: DataFrame) -> DataFrame:
    return lines.filter(_present("order_id", "mobile_number", "order_date_time"))


def drop_unparsed_dates(lines: DataFrame) -> DataFrame:
    """Drop the lines whose timestamp is NULL after parsing."""
    return lines.filter(F.col("order_date_time").isNotNull())


def amount_column_fallback(lines: DataFrame) -> DataFrame:
    """Resolve the amount by column name: total, else order amount, else zero.

    The choice is made from the schema alone, so it costs nothing at run time.
    """
    if "total_amount" in lines.columns:
        return lines.withColumn("total_amount", safe_amount(F.col("total_amount")))
    if "order_amount" in lines.columns:
        return lines.withColumn("order_amount", safe_amount(F.col("order_amount"))).withColumnRenamed(
            "order_amount", "total_amount"
        )
    return lines.withColumn("total_amount", F.lit(0).cast(MONEY))


def is_recent(moment: str, as_of: datetime, days: int = 30) -> Column:
    """True from exactly ``days`` before ``as_of`` on."""
    cutoff = (utc_moment(as_of) - timedelta(days=days)).isoformat(sep=" ")
    return F.col(moment) >= F.lit(cutoff).cast("timestamp_ntz")


def lookback_filter(
    df: DataFrame, as_of: datetime, days: int = 30, moment: str = "order_date_time"
) -> DataFrame:
    return df.filter(is_recent(moment, as_of, days))


def having_min_orders(per_group: DataFrame, more_than: int = 1, count: str = "order_count") -> DataFrame:
    return per_group.filter(F.col(count) > more_than)


def project_customer_map(customers: DataFrame) -> DataFrame:
    """The two columns that the line join needs."""
    return customers.select("customer_id", "mobile_number")


def project_rollup(orders: DataFrame) -> DataFrame:
    """Column order and types of the order rollup."""
    return orders.select(
        "order_id",
        "customer_id",
        F.col("order_amount").cast(MONEY).alias("order_amount"),
        F.to_date("order_date").alias("order_date"),
    )


def union_batches(frames: list[DataFrame]) -> DataFrame:
    """Concatenate by column name; a column that a frame lacks is NULL there."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def sort_desc_amount(df: DataFrame, amount: str, key: str) -> DataFrame:
    """Descending by amount; the key settles ties."""
    return df.orderBy(F.desc(amount), F.asc(key))


def sort_asc_period(df: DataFrame, period: str) -> DataFrame:
    return df.orderBy(F.asc(period))


def top_k(df: DataFrame, amount: str, key: str, k: int = 10) -> DataFrame:
    """The first ``k`` rows by amount: one heap per task, never a full sort."""
    return sort_desc_amount(df, amount, key).limit(k)
