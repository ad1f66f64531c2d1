"""From SKU lines to orders.

A raw order repeats its total on each of its lines, and there are two figures
per order that must not be mixed:

* the *rollup* adds the amounts of the lines (dashboard, loaded table);
* the *grain* takes one amount per order (four-KPI report).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions import to_order_date
from kpiloom.operators.filters import project_rollup
from kpiloom.operators.joins import join_customer_id

_AT = "order_date_time"


def order_grain(lines: DataFrame, how: str = "max") -> DataFrame:
    """One row per order: (order_id, mobile_number, order_amount, order_date_time).

    ``max`` takes the greatest amount and the latest time, ``first`` and
    ``last`` the amount of the earliest or the latest line (ties by amount, then
    mobile number).  Each is one aggregate over one exchange on the order id,
    combined on the map side.
    """
    if how == "max":
        latest = F.max(F.struct(_AT, "mobile_number")).alias("line")
        per_order = lines.groupBy("order_id").agg(F.max("total_amount").alias("amount"), latest)
        amount = F.col("amount")
    elif how in ("first", "last"):
        pick = F.min if how == "first" else F.max
        line = pick(F.struct(_AT, "total_amount", "mobile_number")).alias("line")
        per_order = lines.groupBy("order_id").agg(line)
        amount = F.col("line.total_amount")
    else:
        raise ValueError(f"unknown order grain: {how}")
    return per_order.select(
        "order_id",
        F.col("line.mobile_number").alias("mobile_number"),
        amount.alias("order_amount"),
        F.col(f"line.{_AT}").alias(_AT),
    )


def order_rollup_sum(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """Amounts summed per (order_id, customer_id); no customer is a group too.

    The lines are summed per order and number before they meet the customers,
    so the join moves orders rather than lines.  A number that two customers
    share gives each of them the whole sum, as joining line by line would.
    """
    per_number = lines.groupBy("order_id", "mobile_number").agg(
        F.sum("total_amount").alias("order_amount"), F.max(_AT).alias("order_date")
    )
    orders = (
        join_customer_id(per_number, customers)
        .groupBy("order_id", "customer_id")
        .agg(
            F.sum("order_amount").alias("order_amount"),
            to_order_date(F.max("order_date")).alias("order_date"),
        )
    )
    return project_rollup(orders)
