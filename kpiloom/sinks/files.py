"""Clean datasets as folders, replaced as a whole: parquet, or CSV for export.

Each write makes a new version beside the old one, and readers take the last
complete version.  A write that fails leaves the old data as they were.

A merge replaces some orders only.  Its version holds the months these orders are
and were in; a manifest names the folders of all other months, which stay where an
earlier version wrote them.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions import year_month
from kpiloom.schemas import CLEAN_CUSTOMERS, CLEAN_ORDER_LINES, MONTH_COLUMN, ORDER_ROLLUP
from kpiloom.sources.raw import CSV_OPTIONS
from kpiloom.staging import commit_months, current_version, expire_versions, month_folders, new_version


def _replace(df: DataFrame, path: str, fmt: str, *folders: str) -> None:
    options = CSV_OPTIONS if fmt == "csv" else {}
    writer = df.write.mode("errorifexists").options(**options).format(fmt)
    (writer.partitionBy(*folders) if folders else writer).save(new_version(path))
    expire_versions(df.sparkSession, path)


def _by_month(df: DataFrame, moment: str, path: str, fmt: str) -> None:
    """One folder per month, so that a look-back reads only its months.

    The rebalance hint lets adaptive execution merge the small months and split
    the large ones: no month becomes one task, and no task writes every month.
    """
    months = df.withColumn(MONTH_COLUMN, year_month(F.col(moment)))
    _replace(months.hint("rebalance", F.col(MONTH_COLUMN)), path, fmt, MONTH_COLUMN)


def sink_customers_clean(customers: DataFrame, path: str, fmt: str = "parquet") -> None:
    _replace(customers.select(*CLEAN_CUSTOMERS.names), path, fmt)


def sink_orders_rollup(rollup: DataFrame, path: str, fmt: str = "parquet") -> None:
    _by_month(rollup.select(*ORDER_ROLLUP.names), "order_date", path, fmt)


def sink_orders_lines(lines: DataFrame, path: str, fmt: str = "parquet") -> None:
    _by_month(lines.select(*CLEAN_ORDER_LINES.names), "order_date_time", path, fmt)


# -- merging some orders into a dataset of months ----------------------------------------


def merge_orders_lines(lines: DataFrame, path: str, orders: DataFrame | None, built: dict) -> list[str]:
    """Replace the lines of the named orders (order_id) by ``lines``; see ``_merge``."""
    return _merge(lines, path, orders, built, "order_date_time", CLEAN_ORDER_LINES)


def merge_orders_rollup(rollup: DataFrame, path: str, orders: DataFrame | None, built: dict) -> list[str]:
    """Replace the rollup of the named orders (order_id) by ``rollup``; see ``_merge``."""
    return _merge(rollup, path, orders, built, "order_date", ORDER_ROLLUP)


def _merge(rows: DataFrame, path: str, orders: DataFrame | None, built: dict, moment: str, schema: T.StructType) -> list[str]:
    """Write a version in which ``rows`` stand in the place of all rows of ``orders``.

    Only the months that hold such rows, before or after, are written again, and
    their names returned; ``orders`` of None replaces everything.  ``built`` goes
    into the manifest.  The list of months is all that passes through the driver.
    """
    spark = rows.sparkSession
    month = year_month(F.col(moment)).alias(MONTH_COLUMN)
    new = rows.select(*schema.names, month)
    kept: dict[str, str] = {}
    if orders is not None:
        folders = month_folders(spark, current_version(spark, path))
        held = spark.read.schema(schema).parquet(*folders.values()).select(*schema.names, month) if folders else new.limit(0)
        places = held.join(orders, "order_id", "left_semi").select(MONTH_COLUMN).union(new.select(MONTH_COLUMN)).distinct()
        touched = {row[MONTH_COLUMN] for row in places.collect()}
        kept = {name: folder for name, folder in folders.items() if name not in touched}
        again = [folder for name, folder in folders.items() if name in touched]
        if again:
            left = spark.read.schema(schema).parquet(*again).join(orders, "order_id", "left_anti").select(*schema.names, month)
            new = left.unionByName(new)
    version = new_version(path)
    unmarked = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
    new.hint("rebalance", F.col(MONTH_COLUMN)).write.options(**unmarked).partitionBy(MONTH_COLUMN).parquet(version)
    commit_months(spark, version, kept, built)
    expire_versions(spark, path)
    return sorted(set(month_folders(spark, version)) - set(kept))
