from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from kpiloom.operators import dedupe, filters, joins, kpis, orders
from kpiloom.plans import clean

LINE = "order_id string, mobile_number string, order_date_time timestamp_ntz, sku_id string, total_amount decimal(18,2)"
CUSTOMER = "customer_id string, customer_name string, mobile_number string, region string"
ROLLUP = "order_id string, customer_id string, order_amount decimal(18,2), order_date date"


def at(hour, day=1):
    return datetime(2025, 10, day, hour)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lines(spark, *data):
    return spark.createDataFrame([(o, m, t, s, D(a)) for o, m, t, s, a in data], LINE)


def rollup(spark, *data):
    typed = [(o, c, None if a is None else D(a), d) for o, c, a, d in data]
    return spark.createDataFrame(typed, ROLLUP)


# -- filters ---------------------------------------------------------------


def test_require_columns(spark):
    frame = spark.createDataFrame([("o", "c")], "order_id string, customer_id string")
    assert filters.require_columns(frame, ["order_id"], "rollup") is frame
    with pytest.raises(ValueError, match="order_amount"):
        filters.require_columns(frame, ["order_id", "order_amount"], "rollup")


def test_lookback_is_inclusive(spark):
    as_of = datetime(2025, 11, 5, 12)
    edge = datetime(2025, 10, 6, 12)
    frame = lines(spark, ("A", "1", edge, "s", 1), ("B", "1", datetime(2025, 10, 6, 11, 59, 59), "s", 1))
    assert [r.order_id for r in filters.lookback_filter(frame, as_of).collect()] == ["A"]


def test_amount_column_fallback(spark):
    total = spark.createDataFrame([("A", "5", "9")], "order_id string, total_amount string, order_amount string")
    assert filters.amount_column_fallback(total).first().total_amount == D("5.00")
    other = filters.amount_column_fallback(total.drop("total_amount"))
    assert other.columns == ["order_id", "total_amount"] and other.first().total_amount == D("9.00")
    assert filters.amount_column_fallback(total.select("order_id")).first().total_amount == D("0.00")


def test_union_batches_aligns_by_name(spark):
    one = spark.createDataFrame([("a1", "b1", "c1", "d1")], "a string, b string, c string, d string")
    two = spark.createDataFrame([("a2", "d2", "c2", "b2")], "a string, d string, c string, b string")
    three = spark.createDataFrame([("a3", "b3", "c3")], "a string, b string, c string")
    assert rows(filters.union_batches([one, two, three])) == [
        ("a1", "b1", "c1", "d1"),
        ("a2", "b2", "c2", "d2"),
        ("a3", "b3", "c3", None),
    ]


# -- cleaning and de-duplication -------------------------------------------


def test_dedupe_customers(spark):
    frame = spark.createDataFrame(
        [("C1", "a", "+91-1", "x"), ("C1", "b", "911", "x"), ("C1", "c", "912", "x")], CUSTOMER
    )
    cleaned = clean.clean_customers(frame)
    assert rows(cleaned) == [("C1", "A", "911", "X"), ("C1", "C", "912", "X")]


def test_dedupe_order_lines(spark):
    frame = lines(
        spark,
        ("A", "1", at(0, 2), "S1", 7),
        ("A", "1", at(0, 1), "S1", 5),
        ("A", "1", at(0, 1), "S2", 5),
    )
    kept = dedupe.dedupe_order_lines(frame)
    assert [(r[3], r[4]) for r in rows(kept)] == [("S1", D("5.00")), ("S2", D("5.00"))]
    assert dedupe.dedupe_order_lines(frame.drop("sku_id")).count() == 1


def test_missing_sku_is_one_key(spark):
    frame = lines(spark, ("A", "1", at(1), None, 5), ("A", "1", at(2), None, 6), ("A", "1", at(1), "S", 1))
    assert dedupe.dedupe_order_lines(frame).count() == 2


def test_first_in_input_order_wins(spark):
    """With a position attached, the first row stays even if it is the greater."""
    frame = spark.createDataFrame([("A", "S", 2, 1), ("A", "S", 1, 2)], "order_id string, sku_id string, n int, input_order int")
    assert dedupe.dedupe_order_lines(frame).first().n == 2


def test_clean_orders(spark):
    raw = spark.createDataFrame(
        [
            ("A", "+91 1", "2025-10-01T09:00:00", "S", "2", "74.5"),
            ("B", None, "2025-10-01", "S", "2", "1"),
            ("C", "911", "soon", "S", "2", "1"),
            (None, "911", "2025-10-01", "S", "2", "1"),
            ("D", "unknown", "2025-10-01", "S", "many", "x"),
        ],
        "order_id string, mobile_number string, order_date_time string, sku_id string, sku_count string, total_amount string",
    )
    want = [
        ("A", "911", datetime(2025, 10, 1, 9), "S", 2, D("74.50")),
        ("D", "", datetime(2025, 10, 1), "S", None, D("0.00")),
    ]
    assert rows(clean.clean_orders(raw, blank_mobile="keep")) == want
    assert rows(clean.clean_orders(raw)) == want[:1]
    assert rows(clean.clean_orders(raw, blank_mobile="reject")) == want[:1]
    with pytest.raises(ValueError):
        clean.clean_orders(raw, blank_mobile="maybe")


def test_cleaning_twice_is_cleaning_once(spark):
    raw = spark.createDataFrame(
        [("C1", " ann o'neil ", "+91-1", "west"), ("C2", None, "2", None), (None, "x", "1", "y")], CUSTOMER
    )
    once = clean.clean_customers(raw)
    assert rows(once) == [("C1", "Ann O'Neil", "911", "West"), ("C2", None, "2", None)]
    assert rows(clean.clean_customers(once)) == rows(once)


# -- orders ------------------------------------------------------------------


@pytest.mark.parametrize(("how", "amount", "hour"), [("first", 4, 8), ("last", 3, 10), ("max", 5, 10)])
def test_order_grain(spark, how, amount, hour):
    frame = lines(
        spark, ("A", "1", at(9), "a", 5), ("A", "1", at(10), "b", 3), ("A", "1", at(8), "c", 4)
    )
    assert rows(orders.order_grain(frame, how)) == [("A", "1", D(amount), at(hour))]


def test_order_grain_takes_the_latest_number(spark):
    frame = lines(spark, ("A", "2", at(9), "a", 5), ("A", "1", at(10), "b", 3))
    assert rows(orders.order_grain(frame)) == [("A", "1", D(5), at(10))]
    with pytest.raises(ValueError):
        orders.order_grain(frame, "median")


SHARED = [("C1", "n", "1", "W"), ("C2", "n", "1", "N"), ("C3", "n", "3", "S")]


def test_join_with_a_shared_number(spark):
    frame = lines(spark, ("A", "1", at(9), "a", 5), ("B", "9", at(9), "a", 7))
    customers = spark.createDataFrame(SHARED, CUSTOMER)
    joined = joins.join_customer_id(frame, customers)
    assert sorted((r.order_id, r.customer_id or "") for r in joined.collect()) == [("A", "C1"), ("A", "C2"), ("B", "")]


def test_join_customers_suffixes_shared_columns(spark):
    frame = lines(spark, ("A", "1", at(9), "a", 5)).withColumn("region", F.lit("x"))
    customers = spark.createDataFrame(SHARED[:1], CUSTOMER)
    joined = joins.join_customers(frame, customers)
    assert {"region_order", "region_customer"} <= set(joined.columns)


def test_rollup(spark):
    frame = lines(
        spark,
        ("A", "1", at(9), "a", 5),
        ("A", "1", at(23), "b", 5),
        ("B", "9", at(9, 2), "a", 7),
        ("E", "3", at(1), "a", 1),
        ("E", "1", at(2), "b", 2),
    )
    customers = spark.createDataFrame(SHARED + [("C3", "n", "1", "S")], CUSTOMER)
    day, next_day = at(0).date(), at(0, 2).date()
    assert rows(orders.order_rollup_sum(frame, customers)) == [
        ("A", "C1", D(10), day),
        ("A", "C2", D(10), day),
        ("A", "C3", D(10), day),
        ("B", None, D(7), next_day),
        ("E", "C1", D(2), day),
        ("E", "C2", D(2), day),
        ("E", "C3", D(3), day),
    ]


# -- figures -----------------------------------------------------------------


def one(df):
    return df.first()[0]


def test_customer_counts(spark):
    frame = spark.createDataFrame([("A",), ("A",), (None,)], "customer_id string")
    assert one(kpis.total_customers_distinct(frame)) == 1
    assert one(kpis.total_customers_rows(frame)) == 3
    assert one(kpis.total_customers_with_null(frame)) == 2


DAY = at(0).date()


def test_average_order_value(spark):
    frame = rollup(spark, ("1", "a", 10, DAY), ("2", "a", None, DAY), ("3", "b", 20, DAY))
    assert one(kpis.avg_order_value(frame)) == 15.0
    assert one(kpis.avg_order_value_per_row(frame)) == 10.0
    assert one(kpis.total_revenue(frame)) == 30.0
    assert tuple(kpis.total_orders(frame).first()) == (3, 3)


def test_figures_of_nothing(spark):
    empty = rollup(spark)
    assert one(kpis.total_revenue(empty)) == 0.0
    assert one(kpis.avg_order_value(empty)) == 0.0
    assert one(kpis.repeat_rate(empty)) == 0.0
    assert kpis.daily_orders_filled(empty).count() == 0


def test_repeat_rate(spark):
    owners = ["A", "A", "B", None, None, None]
    frame = rollup(spark, *[(str(i), c, 1, DAY) for i, c in enumerate(owners)])
    assert one(kpis.repeat_rate(frame)) == 50.0
    assert round(one(kpis.repeat_rate(frame, keep_unmatched=True)), 1) == 66.7


def test_daily_orders_filled(spark):
    frame = rollup(spark, ("1", "a", 1, at(0, 1).date()), ("2", "a", 1, at(0, 4).date()), ("3", "b", 1, at(0, 4).date()), ("4", "b", 1, None))
    assert [tuple(r) for r in kpis.daily_orders_filled(frame).collect()] == [
        (at(0, d).date(), n) for d, n in ((1, 1), (2, 0), (3, 0), (4, 2))
    ]


def test_top_customers_breaks_ties_by_id(spark):
    amounts = {f"C{i:02d}": 100 - i for i in range(9)} | {"C98": 5, "C97": 5}
    frame = rollup(spark, *[(c, c, a, DAY) for c, a in amounts.items()], ("x", None, 999, DAY))
    best = [r.customer_id for r in kpis.top_customers(frame).collect()]
    assert len(best) == 10 and best[-1] == "C97"
    assert kpis.top_customers(frame, keep_unmatched=True).first().customer_id is None


def test_all_null_amounts_sum_to_zero(spark):
    frame = rollup(spark, ("1", "a", None, DAY))
    assert tuple(kpis.top_customers(frame).first()) == ("a", 0.0)


def grain_of(spark, *data):
    schema = "order_id string, mobile_number string, order_amount decimal(18,2), order_date_time timestamp_ntz"
    return spark.createDataFrame([(o, m, D(a), t) for o, m, a, t in data], schema)


def test_report_figures_with_unmatched_and_shared_numbers(spark):
    grain = grain_of(spark, ("A", "1", 5, at(9)), ("B", "1", 7, at(9, 2)), ("E", "9", 11, at(9)), ("F", "9", 1, at(9)))
    customers = spark.createDataFrame(SHARED, CUSTOMER)
    assert [tuple(r) for r in kpis.region_revenue(grain, customers).collect()] == [("N", 12.0), ("W", 12.0)]
    assert rows(kpis.region_revenue(grain, customers, True)) == [("N", 12.0), ("W", 12.0), (None, 12.0)]
    assert rows(kpis.repeat_customers(grain, customers)) == [("C1", 2), ("C2", 2)]
    assert rows(kpis.repeat_customers(grain, customers, True)) == [("C1", 2), ("C2", 2), (None, 2)]
    assert one(kpis.repeat_customer_count(grain, customers)) == 2
    spend = kpis.spenders_of_grain(grain, customers, datetime(2025, 11, 1), 30)
    assert [tuple(r) for r in spend.collect()] == [("C1", "n", 7.0), ("C2", "n", 7.0)]


def test_a_customer_listed_twice_is_not_a_repeat_customer(spark):
    customers = spark.createDataFrame([("C1", "n", "1", "W"), ("C1", "m", "1", "W")], CUSTOMER)
    assert kpis.repeat_customers(grain_of(spark, ("A", "1", 5, at(9))), customers).count() == 0


def test_a_customer_with_two_numbers(spark):
    customers = spark.createDataFrame([("C1", "n", "1", "W"), ("C1", "n", "2", "W")], CUSTOMER)
    grain = grain_of(spark, ("A", "1", 5, at(9)), ("B", "2", 6, at(9)))
    assert rows(kpis.repeat_customers(grain, customers)) == [("C1", 2)]
    assert rows(kpis.spenders_of_grain(grain, customers, at(10))) == [("C1", "n", 11.0)]


def test_an_order_over_two_months_counts_in_both(spark):
    frame = lines(spark, ("A", "1", datetime(2025, 9, 30), "a", 5), ("A", "1", at(0), "b", 5), ("B", "1", at(0), "b", 5))
    assert [tuple(r) for r in kpis.monthly_order_trend(frame).collect()] == [("2025-09", 1), ("2025-10", 2)]
