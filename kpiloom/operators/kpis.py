"""Key figures.

Dashboard figures read the order rollup (sum over lines); report figures read
the order grain (one amount per order).  ``keep_unmatched`` decides whether
orders without a customer form a group of their own.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kpiloom.functions import safe_ratio, year_month, zero_if_null
from kpiloom.operators.filters import (
    having_min_orders,
    is_recent,
    sort_asc_period,
    sort_desc_amount,
    top_k,
)
from kpiloom.operators.joins import MOBILE, join_totals, number_owners
from kpiloom.operators.orders import order_grain


def _known_customers(df: DataFrame, keep_unmatched: bool) -> DataFrame:
    return df if keep_unmatched else df.filter(F.col("customer_id").isNotNull())


# -- figures of the customers ------------------------------------------------


def total_customers_distinct(customers: DataFrame) -> DataFrame:
    return customers.agg(F.countDistinct("customer_id").alias("total_customers"))


def total_customers_rows(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count(F.lit(1)).alias("total_customers"))


def total_customers_with_null(customers: DataFrame) -> DataFrame:
    """Distinct ids where a missing id counts as one more."""
    ids = customers.select("customer_id").distinct()
    return ids.agg(F.count(F.lit(1)).alias("total_customers"))


# -- figures of the rollup ---------------------------------------------------


def total_orders(rollup: DataFrame) -> DataFrame:
    return rollup.agg(
        F.count(F.lit(1)).alias("total_orders"), F.count("order_id").alias("identified_orders")
    )


def total_revenue(rollup: DataFrame) -> DataFrame:
    return rollup.agg(zero_if_null(F.sum("order_amount")).cast("double").alias("revenue"))


def avg_order_value(rollup: DataFrame) -> DataFrame:
    """Mean of the amounts that are present."""
    mean = safe_ratio(F.sum("order_amount"), F.count("order_amount"))
    return rollup.agg(mean.alias("avg_order_value"))


def avg_order_value_per_row(rollup: DataFrame) -> DataFrame:
    """Revenue over all rows, those without an amount included."""
    mean = safe_ratio(F.sum("order_amount"), F.count(F.lit(1)))
    return rollup.agg(mean.alias("avg_order_value"))


def orders_per_customer(rollup: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    counted = _known_customers(rollup, keep_unmatched).groupBy("customer_id")
    return counted.agg(F.count(F.lit(1)).alias("order_count"))


def repeat_share(count: str = "order_count") -> Column:
    """Aggregate over one row per customer: percent with more than one order."""
    repeated = F.count_if(F.col(count) > 1)
    return safe_ratio(F.lit(100.0) * repeated, F.count(F.lit(1)))


def repeat_rate(rollup: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    per_customer = orders_per_customer(rollup, keep_unmatched)
    return per_customer.agg(repeat_share().alias("repeat_rate"))


def daily_orders(rollup: DataFrame) -> DataFrame:
    """Orders per day, ascending; a day without orders has no row."""
    per_day = rollup.groupBy(F.to_date("order_date").alias("day"))
    return sort_asc_period(per_day.agg(F.count(F.lit(1)).alias("orders")), "day")


def daily_orders_filled(rollup: DataFrame) -> DataFrame:
    """Orders per day from the first day to the last, zero where there are none.

    Each day also emits the empty days up to the next one, so the orders are
    read once.  The window sees one row per calendar day, whatever the volume.
    A gap is emitted month by month, so no array is longer than a month or than
    the months of the calendar that timestamps cover.
    """
    per_day = rollup.groupBy(F.to_date("order_date").alias("day")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    following = F.lead("day").over(Window.orderBy("day"))
    last = F.coalesce(F.date_sub(following, 1), F.col("day"))
    months = F.sequence(F.trunc("day", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))
    days = F.sequence(F.greatest("day", "month"), F.least("last", F.last_day("month")))
    filled = (
        per_day.filter(F.col("day").isNotNull())
        .select("day", "orders", last.alias("last"))
        .select("day", "orders", "last", F.explode(months).alias("month"))
        .select(F.col("day").alias("ordered"), "orders", F.explode(days).alias("day"))
        .select("day", F.when(F.col("day") == F.col("ordered"), F.col("orders")).otherwise(0).alias("orders"))
    )
    return sort_asc_period(filled, "day")


def customer_totals(rollup: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Orders and revenue of each customer; every scalar figure follows from it."""
    return (
        _known_customers(rollup, keep_unmatched)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.count("order_amount").alias("amount_count"),
            zero_if_null(F.sum("order_amount")).alias("revenue"),
        )
    )


def top_customers(rollup: DataFrame, k: int = 10, keep_unmatched: bool = False) -> DataFrame:
    """The ``k`` best customers by rollup revenue."""
    totals = customer_totals(rollup, keep_unmatched).select("customer_id", "revenue")
    best = top_k(totals, "revenue", "customer_id", k)
    return best.select("customer_id", F.col("revenue").cast("double").alias("revenue"))


# -- figures of the report ---------------------------------------------------


def monthly_order_trend(lines: DataFrame) -> DataFrame:
    """Distinct orders per month.

    Months are grouped as dates and labelled afterwards, once per month instead
    of once per line.  The distinct count exchanges (month, order), so a busy
    month is not one task.
    """
    per_month = lines.groupBy(F.trunc("order_date_time", "month").alias("month")).agg(
        F.countDistinct("order_id").alias("order_count")
    )
    labelled = per_month.select(year_month(F.col("month")).alias("year_month"), "order_count")
    return sort_asc_period(labelled, "year_month")


def number_totals(grain: DataFrame, *extra: Column) -> DataFrame:
    """Orders and revenue per mobile number.

    The report joins this and not the orders: it is unique on the join key, so
    a number with a third of all orders is one row when it meets the customers.
    """
    return grain.groupBy(MOBILE).agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("order_amount").alias("amount"), *extra
    )


def region_revenue(
    grain: DataFrame,
    customers: DataFrame,
    keep_unmatched: bool = False,
    shared_number: str = "each",
) -> DataFrame:
    """Revenue per region at order grain, greatest first."""
    totals = number_totals(grain).select(MOBILE, "amount")
    who = number_owners(customers, shared_number).select(MOBILE, "region")
    joined = join_totals(totals, who, keep_unmatched)
    known = joined if keep_unmatched else joined.filter(F.col("region").isNotNull())
    per_region = known.groupBy("region").agg(zero_if_null(F.sum("amount")).alias("revenue"))
    return sort_desc_amount(per_region, "revenue", "region").select(
        "region", F.col("revenue").cast("double").alias("revenue")
    )


def repeat_customers(
    lines: DataFrame,
    customers: DataFrame,
    keep_unmatched: bool = False,
    shared_number: str = "each",
) -> DataFrame:
    """Customers with more than one order, with the number of their orders.

    Counts distinct orders over the lines: an order with lines on two numbers
    counts for the customers of both.  The lines are combined to (order, number)
    pairs before they are shuffled.  Given the order grain instead, an order
    counts for its one number.
    """
    pairs = lines.select("order_id", MOBILE).distinct()
    who = number_owners(customers, shared_number).select(MOBILE, "customer_id").distinct()
    joined = join_totals(pairs, who, keep_unmatched)
    ordered = joined.select("customer_id", "order_id").distinct()
    return having_min_orders(ordered.groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count")))


def repeat_customer_count(
    lines: DataFrame,
    customers: DataFrame,
    keep_unmatched: bool = False,
    shared_number: str = "each",
) -> DataFrame:
    repeated = repeat_customers(lines, customers, keep_unmatched, shared_number)
    return repeated.agg(F.count(F.lit(1)).alias("repeat_customer_count"))


def top_spenders(
    lines: DataFrame,
    customers: DataFrame,
    as_of: datetime,
    days: int = 30,
    grain: str = "max",
    keep_unmatched: bool = False,
    shared_number: str = "each",
) -> DataFrame:
    """Spend per customer over the lines of the last days, greatest first.

    The look-back applies to the lines, so that it reaches the scan and prunes
    month folders.  ``spenders_of_grain`` applies it to whole orders instead.
    """
    recent = lines.filter(is_recent("order_date_time", as_of, days))
    return _spend(order_grain(recent, grain), customers, keep_unmatched, shared_number)


def spenders_of_grain(
    grain: DataFrame,
    customers: DataFrame,
    as_of: datetime,
    days: int = 30,
    keep_unmatched: bool = False,
    shared_number: str = "each",
) -> DataFrame:
    """Spend per customer over the orders whose latest line is of the last days."""
    recent = grain.filter(is_recent("order_date_time", as_of, days))
    return _spend(recent, customers, keep_unmatched, shared_number)


def _spend(
    grain: DataFrame, customers: DataFrame, keep_unmatched: bool, shared_number: str
) -> DataFrame:
    totals = number_totals(grain).select(MOBILE, "amount")
    who = number_owners(customers, shared_number).select(MOBILE, "customer_id", "customer_name")
    joined = join_totals(totals, who, keep_unmatched)
    spend = joined.groupBy("customer_id", "customer_name").agg(
        zero_if_null(F.sum("amount")).alias("amount")
    )
    ranked = spend.orderBy(F.desc("amount"), "customer_id", "customer_name")
    return ranked.select(
        "customer_id", "customer_name", F.col("amount").cast("double").alias("amount")
    )
