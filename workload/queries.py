"""One Spark query per operator, each over whole tables.

Amounts leave as DOUBLE, after they were summed as decimals.
"""

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom import functions as fn
from kpiloom.operators import dedupe, filters, joins, kpis, orders
from kpiloom.plans import clean, dashboard, jobs, report
from kpiloom.schemas import CUSTOMERS_TABLE, ORDERS_TABLE, RAW_CUSTOMERS, RAW_ORDER_LINES
from kpiloom.sinks import files, tables
from kpiloom.sources import landing, raw
from kpiloom.sources.clean import (
    scan_clean_customers,
    scan_clean_lines,
    scan_clean_rollup,
    scan_recent_lines,
)
from kpiloom.staging import materialize, new_path
from kpiloom.streaming.intake import read_staged_orders, stage_new_orders
from workload import views

AS_OF = datetime(2001, 8, 1)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_written: dict[tuple[str, str, str], str] = {}


def _query(function: Query) -> Query:
    QUERIES[function.__name__.removeprefix("q_")] = function
    return function


def _money_as_double(df: DataFrame) -> DataFrame:
    """Decimal columns as DOUBLE, in their place."""
    decimals = {n: F.col(n).cast("double") for n, t in df.dtypes if t.startswith("decimal")}
    return df.withColumns(decimals) if decimals else df


def _once(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], None]) -> str:
    """The path of a dataset derived from the tables, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _written:
        path = new_path(spark, label)
        write(path)
        _written[key] = path
    return _written[key]


def _grain(spark, sf_dir):
    return orders.order_grain(views.lines(spark, sf_dir))


def _rollup(spark, sf_dir):
    return orders.order_rollup_sum(views.lines(spark, sf_dir), views.customers_part(spark, sf_dir))


def _raw_lines(spark, sf_dir):
    return views.raw_lines(spark, sf_dir).drop("arrived")


def _landed_customers(spark, sf_dir):
    """Customers as CSV, two batches: the second holds other names for the same customers."""

    def write(root: str) -> None:
        for day, copy in enumerate(views.raw_customer_copies(spark, sf_dir)):
            landing.land_batch(copy, root, "csv", datetime(2001, 7, 31, 20, 0) + timedelta(days=day))

    return _once(spark, sf_dir, "landing-customers", write)


def _landed_orders(spark, sf_dir):
    """Order lines as XML, one folder per year of order."""

    def write(root: str) -> None:
        lines = views.raw_lines(spark, sf_dir)
        year = F.date_trunc("year", "arrived").cast("timestamp_ntz")
        dated = lines.withColumn("batch", year).drop("arrived")
        landing.land_batch(dated.select(*RAW_ORDER_LINES.names, "batch"), root, "xml", F.col("batch"))

    return _once(spark, sf_dir, "landing-orders", write)


# -- sources -------------------------------------------------------------------


@_query
def q_scan_customers_csv(spark, sf_dir):
    return raw.scan_customers_csv(spark, _landed_customers(spark, sf_dir)).select(
        *RAW_CUSTOMERS.names
    )


@_query
def q_scan_orders_xml(spark, sf_dir):
    return landing.scan_orders_xml(spark, _landed_orders(spark, sf_dir)).select(*RAW_ORDER_LINES.names)


def _written_lines(spark, sf_dir):
    return _once(
        spark, sf_dir, "lines", lambda path: files.sink_orders_lines(views.lines(spark, sf_dir), path)
    )


def _written_rollup(spark, sf_dir):
    return _once(
        spark, sf_dir, "rollup", lambda path: files.sink_orders_rollup(_rollup(spark, sf_dir), path)
    )


@_query
def q_scan_clean_lines(spark, sf_dir):
    return _money_as_double(scan_clean_lines(spark, _written_lines(spark, sf_dir)))


@_query
def q_scan_clean_rollup(spark, sf_dir):
    return _money_as_double(scan_clean_rollup(spark, _written_rollup(spark, sf_dir)))


@_query
def q_scan_daily_partitions(spark, sf_dir):
    batches = landing.read_order_batches(spark, _landed_orders(spark, sf_dir))
    return batches.rows.select(*RAW_ORDER_LINES.names, landing.DATE_COLUMN)


@_query
def q_scan_daily_customers(spark, sf_dir):
    batches = landing.read_customer_batches(spark, _landed_customers(spark, sf_dir))
    return batches.rows.select(*RAW_CUSTOMERS.names, landing.DATE_COLUMN)


@_query
def q_scan_daily_incremental(spark, sf_dir):
    """The daily order files, parsed by the intake that reads each file once."""
    root = _landed_orders(spark, sf_dir)
    staged = new_path(spark, "intake")
    stage_new_orders(spark, root, staged)
    rows = read_staged_orders(spark, root, staged).rows
    return rows.select(*RAW_ORDER_LINES.names, landing.DATE_COLUMN)


@_query
def q_batch_summary(spark, sf_dir):
    """Days and row counts of the landed batches and of their cleaned rows."""
    customers = landing.read_customer_batches(spark, _landed_customers(spark, sf_dir))
    lines = landing.read_order_batches(spark, _landed_orders(spark, sf_dir))
    summary = jobs.batch_summary(
        customers, lines, clean.clean_customers(customers.rows), clean.clean_orders(lines.rows)
    )
    return summary.withColumn("partitions", F.array_join("partitions", ","))


@_query
def q_partition_date_ist(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    return events.select("event_id", fn.partition_date_ist(F.col("ts")).alias("ingest_date"))


@_query
def q_land_batch(spark, sf_dir):
    """Rows per landing folder."""
    root = _landed_orders(spark, sf_dir)
    text = landing.scan_orders_xml(spark, root)
    return text.groupBy(landing.DATE_COLUMN).agg(F.count(F.lit(1)).alias("lines"))


@_query
def q_require_columns(spark, sf_dir):
    checked = filters.require_columns(_rollup(spark, sf_dir), ORDERS_TABLE.names, "order rollup")
    return _money_as_double(checked)


# -- sinks ---------------------------------------------------------------------


@_query
def q_sink_customers_clean(spark, sf_dir):
    path = new_path(spark, "customers-clean")
    files.sink_customers_clean(clean.clean_customers(views.raw_customers(spark, sf_dir)), path)
    return scan_clean_customers(spark, path)


@_query
def q_sink_orders_rollup(spark, sf_dir):
    path = new_path(spark, "orders-rollup")
    files.sink_orders_rollup(_rollup(spark, sf_dir), path)
    return _money_as_double(scan_clean_rollup(spark, path))


@_query
def q_sink_orders_lines(spark, sf_dir):
    path = new_path(spark, "orders-lines")
    files.sink_orders_lines(clean.clean_orders(_raw_lines(spark, sf_dir)), path)
    return _money_as_double(scan_clean_lines(spark, path))


def _database(spark) -> str:
    """A database of its own for one call, inside the shared folder."""
    name = f"kpiloom_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{new_path(spark, 'database')}'")
    return name


@_query
def q_ensure_tables(spark, sf_dir):
    """Both tables, created and filled; creating them again changes nothing."""
    database = _database(spark)
    tables.ensure_tables(spark, database)
    customers = clean.clean_customers(views.raw_customers(spark, sf_dir))
    customers.select(*CUSTOMERS_TABLE.names).write.insertInto(f"{database}.{tables.CUSTOMERS}")
    tables.ensure_tables(spark, database)
    return spark.table(f"{database}.{tables.CUSTOMERS}")


@_query
def q_load_customers_full(spark, sf_dir):
    database = _database(spark)
    tables.ensure_tables(spark, database)
    tables.load_customers_full(clean.clean_customers(views.raw_customers(spark, sf_dir)), database)
    return spark.table(f"{database}.{tables.CUSTOMERS}")


@_query
def q_load_orders_full(spark, sf_dir):
    database = _database(spark)
    tables.ensure_tables(spark, database)
    tables.load_orders_full(_rollup(spark, sf_dir), database, on_null="drop")
    return _money_as_double(spark.table(f"{database}.{tables.ORDERS}"))


@_query
def q_load_summary(spark, sf_dir):
    return tables.load_all(
        clean.clean_customers(views.raw_customers(spark, sf_dir)),
        _rollup(spark, sf_dir),
        _database(spark),
        on_null="drop",
    )


# -- projections, filters ------------------------------------------------------


@_query
def q_drop_null_customer_keys(spark, sf_dir):
    return filters.drop_null_customer_keys(views.raw_customers(spark, sf_dir))


@_query
def q_drop_null_order_keys(spark, sf_dir):
    return filters.drop_null_order_keys(_raw_lines(spark, sf_dir))


@_query
def q_drop_unparsed_dates(spark, sf_dir):
    lines = _raw_lines(spark, sf_dir)
    parsed = lines.withColumn("order_date_time", fn.safe_timestamp(F.col("order_date_time")))
    return filters.drop_unparsed_dates(parsed)


@_query
def q_amount_column_fallback(spark, sf_dir):
    """Each of the three cases once over all lines."""
    lines = _raw_lines(spark, sf_dir).select("order_id", "sku_id", "total_amount")
    cases = {
        "total": lines,
        "order": lines.withColumnRenamed("total_amount", "order_amount"),
        "none": lines.drop("total_amount"),
    }
    resolved = [
        filters.amount_column_fallback(df).withColumn("variant", F.lit(case))
        for case, df in cases.items()
    ]
    return _money_as_double(filters.union_batches(resolved))


@_query
def q_lookback_filter(spark, sf_dir):
    recent = filters.lookback_filter(views.lines(spark, sf_dir), AS_OF, 30)
    return _money_as_double(recent)


@_query
def q_having_min_orders(spark, sf_dir):
    return filters.having_min_orders(kpis.orders_per_customer(_rollup(spark, sf_dir)))


@_query
def q_project_customer_map(spark, sf_dir):
    return filters.project_customer_map(views.customers(spark, sf_dir))


@_query
def q_project_rollup(spark, sf_dir):
    lines = views.lines(spark, sf_dir).select(
        "order_id",
        F.col("mobile_number").alias("customer_id"),
        F.col("total_amount").alias("order_amount"),
        F.col("order_date_time").alias("order_date"),
        "sku_id",
    )
    return _money_as_double(filters.project_rollup(lines))


# -- scalar functions ----------------------------------------------------------


@_query
def q_trim_text(spark, sf_dir):
    customers = views.raw_customers(spark, sf_dir)
    names = customers.select("customer_id", fn.trim_text(F.col("customer_name")).alias("text"))
    documents = views.table(spark, sf_dir, "documents")
    texts = documents.select(
        F.col("doc_id").cast("string").alias("customer_id"),
        fn.trim_text(F.concat(F.lit("\t\n"), F.col("text"), F.lit(" \r\n"))).alias("text"),
    )
    return names.unionByName(texts)


@_query
def q_title_case(spark, sf_dir):
    customers = views.raw_customers(spark, sf_dir)
    names = customers.select("customer_id", fn.title_case(F.col("region")).alias("text"))
    documents = views.table(spark, sf_dir, "documents")
    texts = documents.select(
        F.col("doc_id").cast("string").alias("customer_id"), fn.title_case(F.col("text")).alias("text")
    )
    return names.unionByName(texts)


@_query
def q_digits_only(spark, sf_dir):
    customers = views.raw_customers(spark, sf_dir)
    numbers = customers.select("customer_id", fn.digits_only(F.col("mobile_number")).alias("digits"))
    documents = views.table(spark, sf_dir, "documents")
    texts = documents.select(
        F.col("doc_id").cast("string").alias("customer_id"),
        fn.digits_only(F.col("text")).alias("digits"),
    )
    return numbers.unionByName(texts)


@_query
def q_safe_timestamp(spark, sf_dir):
    moment = fn.safe_timestamp(F.col("order_date_time")).alias("moment")
    return _raw_lines(spark, sf_dir).select("order_id", "sku_id", moment)


@_query
def q_safe_amount(spark, sf_dir):
    amount = fn.safe_amount(F.col("total_amount")).cast("double").alias("amount")
    return _raw_lines(spark, sf_dir).select("order_id", "sku_id", amount)


@_query
def q_to_order_date(spark, sf_dir):
    day = fn.to_order_date(F.col("ts")).alias("order_date")
    return views.table(spark, sf_dir, "events").select("event_id", day)


@_query
def q_parse_iso_date(spark, sf_dir):
    day = fn.parse_iso_date(F.col("order_date_time")).alias("order_date")
    return _raw_lines(spark, sf_dir).select("order_id", "sku_id", day)


@_query
def q_year_month(spark, sf_dir):
    month = fn.year_month(F.col("ts")).alias("year_month")
    return views.table(spark, sf_dir, "events").select("event_id", month)


@_query
def q_day_of(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", fn.day_of(F.col("ts")).alias("day"))


@_query
def q_cast_load_types(spark, sf_dir):
    text = _rollup(spark, sf_dir)
    as_text = text.select(*[F.col(name).cast("string").alias(name) for name in text.columns])
    return _money_as_double(tables.cast_load_types(as_text))


@_query
def q_zero_if_null(spark, sf_dir):
    amount = fn.zero_if_null(F.col("total_amount").try_cast("decimal(18,2)"))
    return _raw_lines(spark, sf_dir).select("order_id", "sku_id", amount.cast("double").alias("amount"))


@_query
def q_safe_ratio(spark, sf_dir):
    """Price per unit of discount, zero where there is no discount."""
    ratio = fn.safe_ratio(F.col("l_extendedprice"), F.col("l_discount"))
    return views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", ratio.alias("ratio")
    )


@_query
def q_format_money(spark, sf_dir):
    money = fn.format_money(F.col("o_totalprice")).alias("money")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", money)


@_query
def q_format_pct(spark, sf_dir):
    """Discounts as percent, and their hundredths for ties at one decimal."""
    items = views.table(spark, sf_dir, "lineitem")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        fn.format_pct(F.col("l_discount") * 100).alias("percent"),
        fn.format_pct(F.col("l_quantity") / 4).alias("quarters"),
    )


# -- de-duplication ------------------------------------------------------------


@_query
def q_dedupe_customers(spark, sf_dir):
    customers = views.raw_customers(spark, sf_dir)
    numbers = customers.withColumn("mobile_number", fn.digits_only(F.col("mobile_number")))
    return dedupe.dedupe_customers(numbers)


@_query
def q_dedupe_order_lines(spark, sf_dir):
    return _money_as_double(dedupe.dedupe_order_lines(views.lines(spark, sf_dir)))


@_query
def q_dedupe_orders_without_sku(spark, sf_dir):
    return _money_as_double(dedupe.dedupe_order_lines(views.lines(spark, sf_dir).drop("sku_id")))


def _lines_with_own_amounts(spark, sf_dir):
    """Lines whose amount and time differ within an order: price and ship date."""
    items = views.table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.concat(F.lit("91"), F.col("l_suppkey").cast("string")).alias("mobile_number"),
        F.col("l_shipdate").alias("order_date_time"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("total_amount"),
    )


def _grain_query(how: str) -> Query:
    def query(spark, sf_dir):
        return _money_as_double(orders.order_grain(_lines_with_own_amounts(spark, sf_dir), how))

    return query


for _how in ("max", "first", "last"):
    QUERIES[f"order_grain_{_how}"] = _grain_query(_how)


# -- joins ---------------------------------------------------------------------


@_query
def q_join_lines_customer_id_left(spark, sf_dir):
    lines, customers = views.lines(spark, sf_dir), views.customers_part(spark, sf_dir)
    return _money_as_double(joins.join_customer_id(lines, customers))


@_query
def q_join_lines_customers_left(spark, sf_dir):
    lines, customers = views.lines(spark, sf_dir), views.customers_part(spark, sf_dir)
    return _money_as_double(joins.join_customers(lines, customers, "left"))


@_query
def q_join_grain_customers_inner(spark, sf_dir):
    grain, customers = _grain(spark, sf_dir), views.customers_part(spark, sf_dir)
    return _money_as_double(joins.join_customers(grain, customers, "inner"))


@_query
def q_join_lines_customers_inner(spark, sf_dir):
    lines, customers = views.lines(spark, sf_dir), views.customers_part(spark, sf_dir)
    return _money_as_double(joins.join_customers(lines, customers, "inner"))


# -- aggregates ----------------------------------------------------------------


@_query
def q_order_rollup_sum(spark, sf_dir):
    return _money_as_double(_rollup(spark, sf_dir))


@_query
def q_total_customers_distinct(spark, sf_dir):
    return kpis.total_customers_distinct(views.raw_customers(spark, sf_dir))


@_query
def q_total_customers_rows(spark, sf_dir):
    return kpis.total_customers_rows(views.raw_customers(spark, sf_dir))


@_query
def q_total_customers_with_null(spark, sf_dir):
    """Over the rollup, where orders without a customer have a NULL id."""
    return kpis.total_customers_with_null(_rollup(spark, sf_dir))


def _rollup_query(figure: Callable[..., DataFrame], **options) -> Query:
    def query(spark, sf_dir):
        return figure(_rollup(spark, sf_dir), **options)

    return query


QUERIES |= {
    "total_orders": _rollup_query(kpis.total_orders),
    "total_revenue": _rollup_query(kpis.total_revenue),
    "avg_order_value": _rollup_query(kpis.avg_order_value),
    "avg_order_value_per_row": _rollup_query(kpis.avg_order_value_per_row),
    "orders_per_customer": _rollup_query(kpis.orders_per_customer),
    "orders_per_customer_keep_unmatched": _rollup_query(kpis.orders_per_customer, keep_unmatched=True),
    "repeat_rate": _rollup_query(kpis.repeat_rate),
    "repeat_rate_keep_unmatched": _rollup_query(kpis.repeat_rate, keep_unmatched=True),
    "daily_orders": _rollup_query(kpis.daily_orders),
    "daily_orders_filled": _rollup_query(kpis.daily_orders_filled),
    "top_customers_10": _rollup_query(kpis.top_customers),
    "top_customers_10_keep_unmatched": _rollup_query(kpis.top_customers, keep_unmatched=True),
    "chart_daily_orders": _rollup_query(dashboard.chart_daily_orders),
    "chart_top_customers": _rollup_query(dashboard.chart_top_customers),
}


@_query
def q_monthly_order_trend(spark, sf_dir):
    return kpis.monthly_order_trend(views.lines(spark, sf_dir))


@_query
def q_region_revenue(spark, sf_dir):
    return kpis.region_revenue(_grain(spark, sf_dir), views.customers_part(spark, sf_dir))


@_query
def q_region_revenue_keep_unmatched(spark, sf_dir):
    return kpis.region_revenue(_grain(spark, sf_dir), views.customers_part(spark, sf_dir), True)


@_query
def q_repeat_customers(spark, sf_dir):
    return kpis.repeat_customers(views.lines(spark, sf_dir), views.customers_part(spark, sf_dir))


@_query
def q_repeat_customers_keep_unmatched(spark, sf_dir):
    return kpis.repeat_customers(views.lines(spark, sf_dir), views.customers_part(spark, sf_dir), True)


@_query
def q_repeat_customer_count(spark, sf_dir):
    return kpis.repeat_customer_count(views.lines(spark, sf_dir), views.customers_part(spark, sf_dir))


@_query
def q_top_spenders(spark, sf_dir):
    return kpis.top_spenders(views.lines(spark, sf_dir), views.customers_part(spark, sf_dir), AS_OF)


@_query
def q_top_spenders_of_grain(spark, sf_dir):
    """The look-back applied to whole orders, by their latest line."""
    return kpis.spenders_of_grain(_grain(spark, sf_dir), views.customers_part(spark, sf_dir), AS_OF)


# Numbers that two customers share and orders on two numbers, in both readings.


def _shared(figure: Callable[..., DataFrame], source: Callable[..., DataFrame], *more, **options) -> Query:
    def query(spark, sf_dir):
        return figure(source(spark, sf_dir), views.shared_customers(spark, sf_dir), *more, **options)

    return query


def _split_grain(spark, sf_dir):
    return orders.order_grain(views.split_lines(spark, sf_dir))


for _number in ("each", "once"):
    QUERIES |= {
        f"region_revenue_shared_{_number}": _shared(kpis.region_revenue, _split_grain, shared_number=_number),
        f"top_spenders_shared_{_number}": _shared(kpis.top_spenders, views.split_lines, AS_OF, shared_number=_number),
        f"repeat_customers_shared_{_number}": _shared(kpis.repeat_customers, views.split_lines, shared_number=_number),
        f"kpi_report_shared_{_number}": _shared(report.kpi_report, views.split_lines, AS_OF, shared_number=_number),
    }


@_query
def q_top_spenders_recent_lines(spark, sf_dir):
    """The look-back applied to the written lines, where it prunes months."""
    recent = scan_recent_lines(spark, _written_lines(spark, sf_dir), AS_OF)
    return kpis.top_spenders(recent, views.customers_part(spark, sf_dir), AS_OF, grain="last", keep_unmatched=True)


# -- sorts, set operations -----------------------------------------------------


def _positions(ordered: DataFrame) -> DataFrame:
    """The place of each row in an ordered result, from 1: its place in its
    partition plus the rows of the partitions before it."""
    numbered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    joined = numbered.withColumn("part", part).join(before, "part")
    return joined.withColumn("position", F.col("before") + F.col("at") - F.shiftleft("part", 33) + 1).drop("part", "before", "at")


@_query
def q_daily_orders_in_order(spark, sf_dir):
    return _positions(kpis.daily_orders(_rollup(spark, sf_dir)))


@_query
def q_region_revenue_in_order(spark, sf_dir):
    return _positions(kpis.region_revenue(_grain(spark, sf_dir), views.customers_part(spark, sf_dir)))


@_query
def q_sort_desc_amount(spark, sf_dir):
    totals = kpis.customer_totals(_rollup(spark, sf_dir)).select("customer_id", "revenue")
    return _money_as_double(_positions(filters.sort_desc_amount(totals, "revenue", "customer_id")))


@_query
def q_sort_asc_period(spark, sf_dir):
    months = _grain(spark, sf_dir).select(fn.year_month(F.col("order_date_time")).alias("year_month"))
    ordered = filters.sort_asc_period(months.groupBy("year_month").count(), "year_month")
    return _positions(ordered.select("year_month", F.col("count").alias("orders")))


@_query
def q_top_k(spark, sf_dir):
    grain = _grain(spark, sf_dir).select("order_id", "order_amount")
    return _money_as_double(_positions(filters.top_k(grain, "order_amount", "order_id", 10)))


@_query
def q_union_batches(spark, sf_dir):
    """Three batches: one in another column order, one without the region."""
    customers = views.raw_customers(spark, sf_dir)
    reordered = customers.select("region", "customer_id", "mobile_number", "customer_name")
    return filters.union_batches([customers, reordered, customers.drop("region")])


# -- reports and jobs ----------------------------------------------------------


@_query
def q_clean_customers(spark, sf_dir):
    return clean.clean_customers(views.raw_customers(spark, sf_dir))


@_query
def q_clean_orders(spark, sf_dir):
    return _money_as_double(clean.clean_orders(_raw_lines(spark, sf_dir)))


@_query
def q_kpi_cards(spark, sf_dir):
    return dashboard.kpi_cards(views.customers(spark, sf_dir), _rollup(spark, sf_dir))


@_query
def q_kpi_bundle(spark, sf_dir):
    rollup = materialize(_rollup(spark, sf_dir), "bundle-rollup")
    return dashboard.bundle_to_json(dashboard.kpi_bundle(views.customers(spark, sf_dir), rollup))


@_query
def q_kpi_report(spark, sf_dir):
    lines, customers = views.lines(spark, sf_dir), views.customers_part(spark, sf_dir)
    return report.kpi_report(lines, customers, AS_OF)


@_query
def q_kpi_report_ranked(spark, sf_dir):
    lines, customers = views.lines(spark, sf_dir), views.customers_part(spark, sf_dir)
    return report.ranked(report.kpi_report(lines, customers, AS_OF))


@_query
def q_merge_new_batches(spark, sf_dir):
    """The intake that parses new files only, run twice: the second time nothing is new."""
    roots = _landed_customers(spark, sf_dir), _landed_orders(spark, sf_dir)
    intake, out = new_path(spark, "intake"), jobs.CleanPaths.under(new_path(spark, "clean"))
    jobs.merge_new_batches(spark, *roots, intake, out)
    summary = jobs.merge_new_batches(spark, *roots, intake, out)
    return summary.withColumn("partitions", F.array_join("partitions", ","))


@_query
def q_merge_and_clean_batches(spark, sf_dir):
    out = jobs.CleanPaths.under(new_path(spark, "clean"))
    summary = jobs.merge_and_clean_batches(
        spark, _landed_customers(spark, sf_dir), _landed_orders(spark, sf_dir), out
    )
    return summary.withColumn("partitions", F.array_join("partitions", ","))


@_query
def q_run_job(spark, sf_dir):
    """Raw files to clean data, tables and KPIs; one row per figure."""
    result = jobs.run_pipeline(
        spark,
        _landed_customers(spark, sf_dir),
        _landed_orders(spark, sf_dir),
        jobs.CleanPaths.under(new_path(spark, "clean")),
        _database(spark),
        AS_OF,
        on_null="drop",
    )

    def rows(df: DataFrame, *names: str) -> DataFrame:
        pairs = [F.struct(F.lit(n).alias("title"), F.col(n).cast("string").alias("value")) for n in names]
        return df.select(F.inline(F.array(*pairs)))

    cards = result.kpis.select(F.inline("cards"))
    report_rows = result.report.select(
        F.concat_ws("/", "kpi", "key", "label").alias("title"),
        F.col("value").cast("decimal(28,2)").cast("string").alias("value"),
    )
    cleaned = rows(
        result.clean, "raw_customers_rows", "raw_orders_rows", "cleaned_customers_rows", "cleaned_orders_rows",
        "skipped_files", "blank_mobile_rows", "unparsed_date_rows",
    )
    loaded = rows(result.load, "customers_loaded", "orders_loaded")
    return cleaned.unionByName(loaded).unionByName(cards).unionByName(report_rows)


QUERIES["run_pipeline"] = q_run_job
