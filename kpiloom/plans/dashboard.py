"""The dashboard: five cards, the data of two charts, and both as one row."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions import format_money, format_pct, safe_ratio
from kpiloom.operators.kpis import (
    customer_totals,
    daily_orders,
    repeat_share,
    top_customers,
    total_customers_distinct,
)

# Engine name, card titles in display order, chart ids and titles.
ENGINE = "spark"
CARD_TITLES = (
    "Total Customers",
    "Total Orders",
    "Revenue",
    "Avg Order Value",
    "Repeat Customer Rate",
)
DAILY_CHART = ("orders_daily", "Orders per Day")
TOP_CHART = ("top_customers", "Top 10 Customers by Revenue")


def _card(position: int, value):
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(CARD_TITLES[position - 1]).alias("title"),
        value.alias("value"),
    )


def kpi_cards(customers: DataFrame, rollup: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """(position, title, value) of the five cards, values as displayed.

    The four order figures come from one aggregate of the rollup: orders per
    customer first, then the totals of those.  Orders without a customer count
    in the totals; in the repeat rate only with ``keep_unmatched``.
    """
    per_customer = customer_totals(rollup, keep_unmatched=True)
    in_rate = F.lit(True) if keep_unmatched else F.col("customer_id").isNotNull()
    rated = per_customer.withColumn("rated_count", F.when(in_rate, F.col("order_count")))
    figures = rated.agg(
        F.coalesce(F.sum("order_count"), F.lit(0)).alias("orders"),
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("revenue"),
        safe_ratio(F.sum("revenue"), F.sum("amount_count")).alias("average"),
        safe_ratio(
            F.lit(100.0) * F.count_if(F.col("rated_count") > 1), F.count("rated_count")
        ).alias("rate"),
    )
    order_cards = figures.select(
        F.inline(
            F.array(
                _card(2, F.col("orders").cast("string")),
                _card(3, format_money(F.col("revenue"))),
                _card(4, format_money(F.col("average"))),
                _card(5, format_pct(F.col("rate"))),
            )
        )
    )
    customer_card = total_customers_distinct(customers).select(
        F.inline(F.array(_card(1, F.col("total_customers").cast("string"))))
    )
    return customer_card.unionByName(order_cards)


def chart_daily_orders(rollup: DataFrame) -> DataFrame:
    return daily_orders(rollup)


def chart_top_customers(rollup: DataFrame) -> DataFrame:
    return top_customers(rollup, 10)


def kpi_bundle(customers: DataFrame, rollup: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """One row (engine, cards, charts).

    What is gathered into arrays is bounded by the calendar and the top ten:
    five cards, one point per day, ten customers.
    """
    point = "struct<rank: bigint, label: string, value: decimal(28,2)>"

    def points(df: DataFrame, chart: tuple[str, str], label: str, value: str, rank) -> DataFrame:
        return df.select(
            F.lit(chart[0]).alias("chart"),
            F.lit(None).cast("struct<position: int, title: string, value: string>").alias("card"),
            F.struct(
                rank.alias("rank"),
                F.col(label).cast("string").alias("label"),
                F.col(value).cast("decimal(28,2)").alias("value"),
            ).alias("point"),
        )

    cards = kpi_cards(customers, rollup, keep_unmatched).select(
        F.lit(None).cast("string").alias("chart"),
        F.struct("position", "title", "value").alias("card"),
        F.lit(None).cast(point).alias("point"),
    )
    days = points(chart_daily_orders(rollup), DAILY_CHART, "day", "orders", F.unix_date("day").cast("bigint"))
    # Revenue falls with rank; the exact order is restored by (amount, id) below.
    best = points(chart_top_customers(rollup), TOP_CHART, "customer_id", "revenue", F.lit(0).cast("bigint"))

    def gathered(chart: tuple[str, str]):
        return F.collect_list(F.when(F.col("chart") == chart[0], F.col("point")))

    by_day = F.array_sort(gathered(DAILY_CHART))
    by_revenue = F.array_sort(
        gathered(TOP_CHART),
        lambda a, b: F.when(a["value"] > b["value"], -1)
        .when(a["value"] < b["value"], 1)
        .when(a["label"] < b["label"], -1)
        .when(a["label"] > b["label"], 1)
        .otherwise(0),
    )

    def chart(ids: tuple[str, str], data):
        return F.struct(
            F.lit(ids[0]).alias("id"),
            F.lit(ids[1]).alias("title"),
            F.transform(data, lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value"))).alias("points"),
        )

    merged = cards.unionByName(days).unionByName(best).agg(
        F.array_sort(F.collect_list("card")).alias("cards"),
        by_day.alias("by_day"),
        by_revenue.alias("by_revenue"),
    )
    return merged.select(
        F.lit(ENGINE).alias("engine"),
        F.transform("cards", lambda c: F.struct(c["title"].alias("title"), c["value"].alias("value"))).alias("cards"),
        F.array(chart(DAILY_CHART, F.col("by_day")), chart(TOP_CHART, F.col("by_revenue"))).alias("charts"),
    )


def bundle_to_json(bundle: DataFrame) -> DataFrame:
    """The bundle with its arrays as JSON text, for the edge of the system."""
    return bundle.select("engine", F.to_json("cards").alias("cards"), F.to_json("charts").alias("charts"))
