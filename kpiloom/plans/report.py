"""The four-KPI report as one long table."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions import year_month, zero_if_null
from kpiloom.operators.filters import is_recent
from kpiloom.operators.joins import MOBILE, join_totals, number_owners
from kpiloom.operators.kpis import number_totals, repeat_customers
from kpiloom.operators.orders import order_grain
from kpiloom.staging import materialize


def report_pairs(lines: DataFrame, grain: str = "max") -> DataFrame:
    """One row per order, number and month, from which all KPIs of the report follow.

    The lines are read and shuffled once.  What is kept has the columns of lines
    that ``order_grain`` reads, and the grain of it is the grain of the lines.
    """
    keys = ["order_id", MOBILE, F.trunc("order_date_time", "month").alias("month")]
    if grain == "max":
        picked = [F.max("order_date_time").alias("order_date_time"), F.max("total_amount").alias("total_amount")]
        return lines.groupBy(*keys).agg(*picked)
    pick = F.min if grain == "first" else F.max
    line = pick(F.struct("order_date_time", "total_amount")).alias("line")
    return lines.groupBy(*keys).agg(line).select("order_id", MOBILE, "month", "line.*")


def report_base(
    grain: DataFrame,
    customers: DataFrame,
    as_of: datetime,
    days: int = 30,
    keep_unmatched: bool = False,
    shared_number: str = "each",
) -> DataFrame:
    """Per customer, what the revenue and the spender KPIs need.

    One pass over the orders: totals per number, then the join with the
    customers, then totals per (customer, name, region).
    """
    recent = is_recent("order_date_time", as_of, days)
    totals = number_totals(
        grain,
        F.count_if(recent).alias("recent_count"),
        F.sum(F.when(recent, F.col("order_amount"))).alias("recent_amount"),
    )
    owners = number_owners(customers, shared_number)
    who = owners.select(MOBILE, "customer_id", "customer_name", "region")
    joined = join_totals(totals, who, keep_unmatched)
    sums = ["amount", "recent_count", "recent_amount"]
    return joined.groupBy("customer_id", "customer_name", "region").agg(
        *[F.sum(name).alias(name) for name in sums]
    )


def _rows(df: DataFrame, kpi: str, key: str | None, label: str | None, value: Column) -> DataFrame:
    def text(name: str | None) -> Column:
        return F.lit(None).cast("string") if name is None else F.col(name)

    return df.select(
        F.lit(kpi).alias("kpi"),
        text(key).alias("key"),
        text(label).alias("label"),
        value.cast("double").alias("value"),
    )


def kpi_report(
    lines: DataFrame,
    customers: DataFrame,
    as_of: datetime,
    days: int = 30,
    grain: str = "max",
    keep_unmatched: bool = False,
    shared_number: str = "each",
) -> DataFrame:
    """(kpi, key, label, value) of the monthly trend, the revenue per region, the
    repeat customers with their number, and the recent top spenders.

    The lines are read once, into one written row per order, number and month,
    from which every KPI starts.  Regions and spenders come out of one aggregate.
    ``ranked`` gives the rows of each KPI their places.
    """
    pairs = materialize(report_pairs(lines, grain), "report-pairs")
    trend = pairs.groupBy("month").agg(F.countDistinct("order_id").alias("order_count"))
    trend = trend.select(year_month(F.col("month")).alias("year_month"), "order_count")
    base = report_base(order_grain(pairs, grain), customers, as_of, days, keep_unmatched, shared_number)
    who = ["customer_id", "customer_name"]
    sums = base.groupingSets([["region"], who], "region", *who).agg(
        F.grouping("region").alias("by_customer"),
        zero_if_null(F.sum("amount")).alias("amount"),
        zero_if_null(F.sum("recent_amount")).alias("recent_amount"),
        F.sum("recent_count").alias("recent_count"),
    )
    by_customer = F.col("by_customer") == 1
    wanted = F.when(by_customer, F.col("recent_count") > 0).otherwise(F.lit(True) if keep_unmatched else F.col("region").isNotNull())
    summed = sums.filter(wanted).select(
        F.when(by_customer, "top_spenders").otherwise("region_revenue").alias("kpi"),
        F.when(by_customer, F.col("customer_id")).otherwise(F.col("region")).alias("key"),
        F.when(by_customer, F.col("customer_name")).alias("label"),
        F.when(by_customer, F.col("recent_amount")).otherwise(F.col("amount")).cast("double").alias("value"),
    )
    repeated = repeat_customers(pairs, customers, keep_unmatched, shared_number)
    count = repeated.agg(F.count(F.lit(1)).alias("order_count"))
    return (
        _rows(trend, "monthly_order_trend", "year_month", None, F.col("order_count"))
        .unionByName(summed)
        .unionByName(_rows(repeated, "repeat_customers", "customer_id", None, F.col("order_count")))
        .unionByName(_rows(count, "repeat_customer_count", None, None, F.col("order_count")))
    )


def ranked(report: DataFrame) -> DataFrame:
    """The report with ``rank``, the place of a row within its KPI, from 1.

    Months ascend; everything else descends by value, ties ascend by key and
    label.  No KPI is sorted in one task: the rows are sorted by ranges over all
    tasks, and a place is the place within its range plus the rows before it.
    """
    order = ["kpi", "first", "key", "label"]
    place = F.when(F.col("kpi") == "monthly_order_trend", F.lit(0.0)).otherwise(-F.col("value"))
    spread = report.withColumn("first", place).orderBy(*order)
    numbered = materialize(spread.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    sizes = numbered.groupBy("kpi", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    # one row per KPI and sorted range
    earlier = Window.partitionBy("kpi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("kpi", "part", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    joined = numbered.withColumn("part", part).join(before, ["kpi", "part"])
    return joined.select("kpi", (F.col("at") - F.col("start") + F.col("before") + 1).alias("rank"), "key", "label", "value")
