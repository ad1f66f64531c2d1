"""Clean datasets, read with their declared types from parquet or CSV."""

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.calendar import utc_moment
from kpiloom.operators.filters import lookback_filter
from kpiloom.schemas import CLEAN_CUSTOMERS, CLEAN_ORDER_LINES, MONTH_COLUMN, ORDER_ROLLUP
from kpiloom.sources.raw import CSV_OPTIONS
from kpiloom.staging import current_version, manifest


def _scan(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    version = current_version(spark, path)
    named = manifest(spark, version)
    if named is not None:
        return _months(spark, named["months"].values(), schema)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(enforceSchema="false", **CSV_OPTIONS)
    return reader.format(fmt).load(version).select(*schema.names)


def _months(spark: SparkSession, folders: Iterable[str], schema: T.StructType) -> DataFrame:
    """The rows of month folders that may belong to several versions."""
    folders = list(folders)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def scan_clean_customers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, path, CLEAN_CUSTOMERS, fmt)


def scan_clean_lines(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Row-level clean orders, the timestamp typed by the schema."""
    return _scan(spark, path, CLEAN_ORDER_LINES, fmt)


def scan_clean_rollup(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Order-level clean orders with typed amount and date."""
    return _scan(spark, path, ORDER_ROLLUP, fmt)


def scan_recent_lines(spark: SparkSession, path: str, as_of: datetime, days: int = 30) -> DataFrame:
    """The lines of the last days from month folders, reading only their months."""
    first_month = (utc_moment(as_of) - timedelta(days=days)).strftime("%Y-%m")
    version = current_version(spark, path)
    named = manifest(spark, version)
    if named is not None:
        recent = [folder for month, folder in named["months"].items() if month >= first_month]
        return lookback_filter(_months(spark, recent, CLEAN_ORDER_LINES), as_of, days)
    schema = T.StructType(CLEAN_ORDER_LINES.fields + [T.StructField(MONTH_COLUMN, T.StringType())])
    months = spark.read.schema(schema).parquet(version).filter(F.col(MONTH_COLUMN) >= first_month)
    return lookback_filter(months, as_of, days).select(*CLEAN_ORDER_LINES.names)
