"""Cleaning of raw customers and raw order lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions import digits_only, safe_timestamp, title_case, trim_text
from kpiloom.operators.dedupe import dedupe_customers, dedupe_order_lines
from kpiloom.operators.filters import (
    amount_column_fallback,
    drop_null_customer_keys,
    drop_null_order_keys,
    drop_unparsed_dates,
)


def _blank_mobile(df: DataFrame, policy: str) -> DataFrame:
    """A number without any digit cleans to ''; reject it, or keep it as a key.

    Kept, every such customer meets every such order.
    """
    if policy not in ("keep", "reject"):
        raise ValueError(f"blank_mobile must be 'keep' or 'reject', not {policy!r}")
    return df if policy == "keep" else df.filter(F.col("mobile_number") != "")


def clean_customers(raw: DataFrame, blank_mobile: str = "reject") -> DataFrame:
    """Keyed customers with tidy names and digits-only numbers, one row per key."""
    tidy = drop_null_customer_keys(raw).withColumns(
        {
            "customer_name": title_case(trim_text(F.col("customer_name"))),
            "region": title_case(trim_text(F.col("region"))),
            "mobile_number": digits_only(F.col("mobile_number")),
        }
    )
    return dedupe_customers(_blank_mobile(tidy, blank_mobile))


def clean_orders(raw: DataFrame, blank_mobile: str = "reject") -> DataFrame:
    """Keyed, typed order lines, one row per order and SKU."""
    tidy = drop_null_order_keys(raw).withColumns(
        {
            "mobile_number": digits_only(F.col("mobile_number")),
            "order_date_time": safe_timestamp(F.col("order_date_time")),
        }
    )
    if "sku_count" in raw.columns:
        tidy = tidy.withColumn("sku_count", F.col("sku_count").try_cast("int"))
    typed = amount_column_fallback(drop_unparsed_dates(tidy))
    return dedupe_order_lines(_blank_mobile(typed, blank_mobile))
