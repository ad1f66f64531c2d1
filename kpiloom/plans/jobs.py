"""Whole jobs: merge and clean the daily batches; clean, load and report."""

from datetime import datetime
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import digits_only, safe_timestamp
from kpiloom.operators.orders import order_rollup_sum
from kpiloom.plans.clean import clean_customers, clean_orders
from kpiloom.plans.dashboard import kpi_bundle
from kpiloom.plans.report import kpi_report
from kpiloom.sinks.files import (
    merge_orders_lines,
    merge_orders_rollup,
    sink_customers_clean,
    sink_orders_lines,
    sink_orders_rollup,
)
from kpiloom.sinks.tables import CUSTOMERS, ORDERS, load_all
from kpiloom.sources.clean import scan_clean_customers, scan_clean_lines, scan_clean_rollup
from kpiloom.sources.landing import (
    DATE_COLUMN,
    Batches,
    check_files,
    read_customer_batches,
    read_order_batches,
)
from kpiloom.staging import current_version, manifest, materialize, new_path, remove
from kpiloom.streaming.intake import (
    VERSIONS,
    staged_counts,
    staged_lines,
    staged_skips,
    staged_versions,
    stage_new_orders,
)


class CleanPaths(NamedTuple):
    """Where the clean datasets live."""

    customers: str
    lines: str
    rollup: str

    @classmethod
    def under(cls, root: str) -> "CleanPaths":
        return cls(f"{root}/customers_clean", f"{root}/orders_clean_lines", f"{root}/orders_clean_rollup")


class PipelineResult(NamedTuple):
    clean: DataFrame
    load: DataFrame
    kpis: DataFrame
    report: DataFrame
    skipped: DataFrame


class Cleaning(NamedTuple):
    """How raw rows are cleaned, and what becomes of files that cannot be read."""

    blank_mobile: str = "reject"
    on_bad_file: str = "skip"


def batch_summary(
    customers: Batches,
    orders: Batches,
    cleaned_customers: DataFrame | None,
    cleaned_orders: DataFrame | None,
    order_counts: DataFrame | None = None,
) -> DataFrame:
    """One row: the days read, raw and cleaned row counts (zero if none), and what was
    left out: files skipped whole, rows whose number has no digit, and lines whose
    time does not parse or lies outside the range of timestamps.

    The day of a file that was skipped is not a day read, unless another file
    of that day was.  ``order_counts``, one row per order file, stand in for
    counting the lines of ``orders``.
    """
    blank = F.count_if(digits_only(F.col("mobile_number")) == "")
    moment = F.col("order_date_time")
    unparsed = F.count_if(moment.isNotNull() & safe_timestamp(moment).isNull())
    rows = F.count(F.lit(1))
    of_orders = {"raw_orders_rows": rows, "blank_mobile_rows": blank, "unparsed_date_rows": unparsed}
    lines = orders.rows
    if order_counts is not None:
        lines, of_orders = order_counts, {name: F.coalesce(F.sum(name), F.lit(0)) for name in of_orders}
    counted = [
        (customers.rows, {"raw_customers_rows": rows, "blank_mobile_rows": blank}),
        (lines, of_orders),
        (cleaned_customers, {"cleaned_customers_rows": rows}),
        (cleaned_orders, {"cleaned_orders_rows": rows}),
        (customers.skipped, {"skipped_files": rows}),
        (orders.skipped, {"skipped_files": rows}),
    ]
    parts = [
        days.select(F.col(DATE_COLUMN).cast("string").alias("day"))
        .distinct().select("day", F.lit("").alias("count_of"), F.lit(0).cast("bigint").alias("n"))
        for days in (customers.rows, lines)
    ]
    for df, counts in counted:
        if df is not None:
            totals = df.agg(*[count.alias(name) for name, count in counts.items()])
            pairs = [F.struct(F.lit(name).alias("count_of"), F.col(name).cast("bigint").alias("n")) for name in counts]
            parts.append(totals.select(F.inline(F.array(*pairs))).select(F.lit(None).cast("string").alias("day"), "count_of", "n"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    names = (
        "raw_customers_rows", "raw_orders_rows", "cleaned_customers_rows", "cleaned_orders_rows",
        "skipped_files", "blank_mobile_rows", "unparsed_date_rows",
    )
    sums = [
        F.coalesce(F.sum(F.when(F.col("count_of") == name, F.col("n"))), F.lit(0)).alias(name)
        for name in names
    ]
    return merged.agg(F.array_sort(F.collect_set("day")).alias("partitions"), *sums)


class Cleaned(NamedTuple):
    """What a merge wrote: the summary, the files that were skipped, and the orders whose
    lines it replaced (order_id; None for all)."""

    summary: DataFrame
    skipped: DataFrame
    orders: DataFrame | None


def _clean_customers(spark: SparkSession, customers: Batches, out: CleanPaths, blank_mobile: str) -> DataFrame | None:
    """A kind of data that no day delivered leaves its clean dataset as it was."""
    if customers.rows.isEmpty():
        return None
    cleaned = clean_customers(customers.rows.drop(DATE_COLUMN), blank_mobile)
    sink_customers_clean(cleaned, out.customers)
    return scan_clean_customers(spark, out.customers)


def _merged(
    spark: SparkSession, customers_root: str, orders_root: str, out: CleanPaths, cleaning: Cleaning, intake: str | None
) -> Cleaned:
    """Read, clean and write both kinds of data; with an intake, only what its new files touch."""
    if intake is not None:
        return _merged_new(spark, customers_root, orders_root, out, cleaning, intake)
    customers = read_customer_batches(spark, customers_root, cleaning.on_bad_file)
    orders = read_order_batches(spark, orders_root, cleaning.on_bad_file)
    cleaned_customers = _clean_customers(spark, customers, out, cleaning.blank_mobile)
    cleaned_orders = None
    if not orders.rows.isEmpty():
        sink_orders_lines(clean_orders(orders.rows.drop(DATE_COLUMN), cleaning.blank_mobile), out.lines)
        cleaned_orders = scan_clean_lines(spark, out.lines)
    summary = batch_summary(customers, orders, cleaned_customers, cleaned_orders)
    return Cleaned(summary, customers.skipped.unionByName(orders.skipped), None)


def _merged_new(
    spark: SparkSession, customers_root: str, orders_root: str, out: CleanPaths, cleaning: Cleaning, intake: str
) -> Cleaned:
    """The same result from new files alone.

    An order is touched if a file that has one of its lines is new, was replaced
    or is gone since the clean lines were written.  Its lines are cleaned again
    from all staged ones, and only the months it was or is in are rewritten.
    """
    customers = read_customer_batches(spark, customers_root, cleaning.on_bad_file)
    stage_new_orders(spark, orders_root, intake)
    versions = materialize(staged_versions(spark, orders_root, intake), "versions")
    skipped = staged_skips(spark, intake, versions)
    check_files(Batches(skipped, skipped), cleaning.on_bad_file)
    counts = staged_counts(spark, intake, versions)
    cleaned_customers = _clean_customers(spark, customers, out, cleaning.blank_mobile)
    touched, cleaned_orders = None, None
    if not counts.isEmpty():
        touched = _clean_touched(spark, out.lines, cleaning.blank_mobile, intake, versions)
        cleaned_orders = scan_clean_lines(spark, out.lines)
    orders = Batches(counts, skipped)
    summary = batch_summary(customers, orders, cleaned_customers, cleaned_orders, counts)
    return Cleaned(summary, customers.skipped.unionByName(skipped), touched)


def _built(spark: SparkSession, path: str, wanted: dict[str, str], of: str) -> str | None:
    """What the dataset at ``path`` records under ``of``, if it was built as wanted."""
    named = manifest(spark, current_version(spark, path))
    if named is None or any(named["built"].get(key) != value for key, value in wanted.items()):
        return None
    return named["built"].get(of)


def _clean_touched(spark: SparkSession, path: str, blank_mobile: str, intake: str, versions: DataFrame) -> DataFrame | None:
    """Brings the clean lines up to date; the orders whose lines changed, None for all."""
    wanted = {"blank_mobile": blank_mobile, "intake": intake}
    sources = _built(spark, path, wanted, "sources")
    try:
        before = None if sources is None else spark.read.schema(VERSIONS).parquet(sources)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        before = None  # the record is gone: start again
    touched = None
    if before is not None:
        keys = ["source_file", "batch"]
        changed = materialize(versions.join(before, keys, "left_anti").union(before.join(versions, keys, "left_anti")), "changed")
        touched = staged_lines(spark, intake, changed).select("order_id").filter("order_id IS NOT NULL").distinct()
        touched = materialize(touched, "touched-orders")
        if changed.isEmpty():
            return touched
    lines = staged_lines(spark, intake, versions).drop(DATE_COLUMN, "source_file", "batch")
    if touched is not None:
        lines = lines.join(touched, "order_id", "left_semi").select(*lines.columns)
    record = f"{intake}/sources/{new_path(spark, 'built').rpartition('/')[2]}"
    versions.write.parquet(record)
    merge_orders_lines(clean_orders(lines, blank_mobile), path, touched, {**wanted, "sources": record})
    if sources is not None:
        remove(spark, sources)
    return touched


def _roll_up(spark: SparkSession, out: CleanPaths, cleaned: Cleaned, before: CleanPaths) -> None:
    """Brings the rollup up to date with the clean lines and customers.

    ``before`` names the versions that both had before the merge.  If the rollup was built
    from these, only the orders change whose lines did, or that are on a number
    whose customers did.
    """
    customers, lines = scan_clean_customers(spark, out.customers), scan_clean_lines(spark, out.lines)
    built = {"customers": current_version(spark, out.customers), "lines": current_version(spark, out.lines)}
    orders = None
    if cleaned.orders is not None and _built(spark, out.rollup, {"lines": before.lines}, "customers") == before.customers:
        numbers = ["customer_id", "mobile_number"]
        old = scan_clean_customers(spark, before.customers).select(*numbers)
        new = customers.select(*numbers)
        moved = old.exceptAll(new).union(new.exceptAll(old)).select("mobile_number").distinct()
        of_moved = lines.join(moved, "mobile_number", "left_semi").select("order_id")
        orders = materialize(cleaned.orders.union(of_moved).distinct(), "orders-to-roll-up")
        if orders.isEmpty() and built["lines"] == before.lines and built["customers"] == before.customers:
            return
        lines = lines.join(orders, "order_id", "left_semi")
    merge_orders_rollup(order_rollup_sum(lines, customers), out.rollup, orders, built)


def merge_and_clean_batches(
    spark: SparkSession, customers_root: str, orders_root: str, out: CleanPaths, cleaning: Cleaning = Cleaning()
) -> DataFrame:
    """Read all days, clean both datasets, write them, and return the summary."""
    return _merged(spark, customers_root, orders_root, out, cleaning, None).summary


def merge_new_batches(
    spark: SparkSession,
    customers_root: str,
    orders_root: str,
    intake: str,
    out: CleanPaths,
    cleaning: Cleaning = Cleaning(),
) -> DataFrame:
    """The same result, with only the order files that are new since the last call parsed,
    and only the months that their orders touch written.

    ``intake`` is a folder that keeps the parsed lines and their ledger.
    """
    return _merged(spark, customers_root, orders_root, out, cleaning, intake).summary


def run_pipeline(
    spark: SparkSession,
    customers_root: str,
    orders_root: str,
    out: CleanPaths,
    database: str,
    as_of: datetime,
    on_null: str = "fail",
    on_duplicate: str = "fail",
    grain: str = "max",
    days: int = 30,
    keep_unmatched: bool = False,
    shared_number: str = "each",
    cleaning: Cleaning = Cleaning(),
    intake: str | None = None,
) -> PipelineResult:
    """Clean, roll up, load and report in order; any failing step fails the job.

    Each step starts from the written result of the step before it.  With
    ``intake``, only order files that are new since the last run are parsed, and
    only the months that their orders touch are cleaned and rolled up.
    """
    before = CleanPaths(*(current_version(spark, path) for path in out))
    cleaned = _merged(spark, customers_root, orders_root, out, cleaning, intake)
    summary, skipped = cleaned.summary, cleaned.skipped
    customers = scan_clean_customers(spark, out.customers)
    lines = scan_clean_lines(spark, out.lines)
    if intake is None:
        sink_orders_rollup(order_rollup_sum(lines, customers), out.rollup)
    else:
        _roll_up(spark, out, cleaned, before)
    rollup = scan_clean_rollup(spark, out.rollup)
    loaded = load_all(customers, rollup, database, on_null=on_null, on_duplicate=on_duplicate)
    bundle = kpi_bundle(spark.table(f"{database}.{CUSTOMERS}"), spark.table(f"{database}.{ORDERS}"))
    report = kpi_report(lines, customers, as_of, days, grain, keep_unmatched, shared_number)
    return PipelineResult(summary, loaded, bundle, report, skipped)
