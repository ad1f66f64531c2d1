"""The plans that the operators must keep as the data grows."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kpiloom.operators import dedupe, filters, kpis, orders
from kpiloom.plans import clean

LINE = "order_id string, mobile_number string, order_date_time timestamp_ntz, sku_id string, sku_count int, total_amount decimal(18,2)"
CUSTOMER = "customer_id string, customer_name string, mobile_number string, region string"
AS_OF = datetime(2025, 11, 5)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "lines")
    spark.createDataFrame([], LINE).write.parquet(path)
    return spark.read.schema(LINE).parquet(path)


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "customers")
    spark.createDataFrame([], CUSTOMER).write.parquet(path)
    return spark.read.schema(CUSTOMER).parquet(path)


@pytest.fixture
def merged(spark):
    """No table is small enough to broadcast, as at full size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange (\w+partitioning\([^)]*\)|SinglePartition)", text)


def read_schema(text: str) -> set[str]:
    """The columns that the scan reads; the plan may cut long lists short."""
    return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>\n]*)", text)[1]))


@pytest.mark.parametrize("how", ["max", "first", "last"])
def test_order_grain_is_one_combined_exchange(lines, plan, how):
    text = plan(orders.order_grain(lines, how))
    assert len(exchanges(text)) == 1 and "order_id" in exchanges(text)[0]
    assert "partial_" in text
    assert "sku_id" not in read_schema(text)


@pytest.mark.parametrize("keep_first", [dedupe.dedupe_order_lines, clean.clean_orders])
def test_keep_first_is_one_combined_exchange(lines, plan, keep_first):
    text = plan(keep_first(lines))
    assert len(exchanges(text)) == 1 and "partial_min" in text and "Window" not in text


def test_lines_are_combined_before_any_exchange(lines, customers, merged, plan):
    """Above the scan of the lines stands an aggregate, and only then an exchange."""
    grain = orders.order_grain(lines)
    for df in (
        orders.order_rollup_sum(lines, customers),
        kpis.region_revenue(grain, customers),
        kpis.spenders_of_grain(grain, customers, AS_OF),
        kpis.monthly_order_trend(lines),
    ):
        steps = plan(df).splitlines()
        scan = next(i for i, s in enumerate(steps) if "Scan" in s and "order_id" in s)
        above = [s for s in steps[:scan] if "Exchange" in s or "Aggregate" in s]
        assert "Aggregate" in above[-1], above


def test_orders_meet_customers_as_one_row_per_number(lines, customers, merged, plan):
    """One exchange for the totals, then one on each side of the join."""
    text = plan(kpis.region_revenue(orders.order_grain(lines), customers))
    on_number = [e for e in exchanges(text) if "mobile_number" in e]
    assert len(on_number) == 3 and "SortMergeJoin" in text


def test_columns_are_pruned(lines, plan):
    assert read_schema(plan(kpis.monthly_order_trend(lines))) == {"order_id", "order_date_time"}
    assert read_schema(plan(orders.order_grain(lines).select("order_id", "order_amount"))) == {"order_id", "total_amount"}


def test_lookback_reaches_the_scan(lines, plan):
    text = plan(filters.lookback_filter(lines, AS_OF))
    assert "GreaterThanOrEqual(order_date_time,2025-10-06T00:00)" in text


def test_null_keys_are_dropped_at_the_scan(lines, plan):
    assert "IsNotNull(mobile_number)" in plan(filters.drop_null_order_keys(lines))


def test_top_ten_is_no_full_sort(lines, customers, plan):
    text = plan(kpis.top_customers(orders.order_rollup_sum(lines, customers)))
    assert "TakeOrderedAndProject(limit=10" in text


def test_cleaning_runs_no_python(lines, customers, plan):
    for df in (clean.clean_orders(lines), clean.clean_customers(customers)):
        assert not re.search(r"Python|Pandas|ArrowEval", plan(df))


def test_scalar_functions_stay_in_generated_code(spark, lines, customers, plan):
    """Every projection of the cleaning is inside a whole-stage codegen span."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        texts = [plan(clean.clean_customers(customers)), plan(clean.clean_orders(lines))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    steps = [line for text in texts for line in text.splitlines()]
    work = [s for s in steps if re.search(r"(Project|Filter) [\[(]", s)]
    assert any("initcap" in s for s in work) and any("regexp_replace" in s for s in work)
    assert all(re.search(r"\*\(\d+\) (Project|Filter)", s) for s in work)
