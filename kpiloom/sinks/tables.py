"""Full reload of the tables `customers` and `orders`.

A load writes new versions in folders of their own, checks them, and commits last:
one small file names the current version of both tables, and both are read through
views that follow it.  So a load that fails or stops, at any step, leaves the old
rows alone, at every moment each table is whole, and never is one table new and the
other old.

A database that was never loaded has plain tables.  Its first load copies their rows
as the first version, puts the views in their place, and then goes on as any other.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions import parse_iso_date
from kpiloom.operators.filters import require_columns
from kpiloom.schemas import CUSTOMERS_TABLE, MONEY, ORDERS_TABLE
from kpiloom.staging import expire_files, expire_versions, new_version, remove, write_text

# The names of the two tables.
CUSTOMERS = "customers"
ORDERS = "orders"


class LoadError(ValueError):
    """The data breaks a constraint of the table; nothing was replaced."""


_SCHEMAS = {CUSTOMERS: CUSTOMERS_TABLE, ORDERS: ORDERS_TABLE}


def ensure_tables(spark: SparkSession, database: str) -> None:
    """Create the database and both tables where they are absent."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in _SCHEMAS.items():
        if _committed(spark, database):
            _create_view(spark, database, name)
        else:
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def _home(spark: SparkSession, database: str) -> str:
    return spark.catalog.getDatabase(database).locationUri.rstrip("/")


def _commits(spark: SparkSession, database: str) -> str:
    """The folder of commits: the text of the last one names the version of each table."""
    return f"{_home(spark, database)}/commits"


def _committed(spark: SparkSession, database: str) -> dict[str, str]:
    """The current version of each table, nothing if none was loaded."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_commits(spark, database))
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return {}
    last = spark.read.text(_commits(spark, database)).agg(F.max("value")).first()[0]
    return dict(zip(_SCHEMAS, last.split(" ")[1:], strict=True)) if last else {}


def _commit(spark: SparkSession, database: str, versions: dict[str, str]) -> None:
    """Make these the current versions, of both tables at once."""
    name = new_version("").rpartition("=")[2]
    current = [versions[table].rpartition("=")[2] for table in _SCHEMAS]
    write_text(spark, f"{_commits(spark, database)}/{name}", " ".join([name, *current]) + "\n")
    expire_files(spark, _commits(spark, database))
    for table in _SCHEMAS:
        expire_versions(spark, _versions_of(spark, database, table))


def _create_view(spark: SparkSession, database: str, table: str) -> None:
    """A view of the version that the last commit names; only that folder is read.

    It replaces a plain table that stands there, whose rows are in the first version.
    """
    if spark.catalog.tableExists(f"{database}.{table}"):
        if spark.catalog.getTable(f"{database}.{table}").tableType == "VIEW":
            return
        spark.sql(f"DROP TABLE {database}.{table}")
    place = 1 + list(_SCHEMAS).index(table)
    current = f"SELECT split(max(value), ' ')[{place}] FROM text.`{_commits(spark, database)}`"
    spark.sql(
        f"CREATE VIEW {database}.{table} AS SELECT {', '.join(_SCHEMAS[table].names)} "
        f"FROM parquet.`{_versions_of(spark, database, table)}` WHERE version = ({current})"
    )


def _follow_commits(spark: SparkSession, database: str) -> None:
    """Put views in the place of the plain tables, with the same rows."""
    if _committed(spark, database):
        ensure_tables(spark, database)  # a view may be missing where this stopped
        return
    first = {}
    for table in _SCHEMAS:
        first[table] = new_version(_versions_of(spark, database, table))
        spark.table(f"{database}.{table}").write.parquet(first[table])
    _commit(spark, database, first)
    for table in _SCHEMAS:
        _create_view(spark, database, table)


def cast_load_types(rollup: DataFrame) -> DataFrame:
    """The rollup typed as the table has it; ids stay text."""
    return rollup.select(
        F.col("order_id").cast("string").alias("order_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("order_amount").cast(MONEY).alias("order_amount"),
        parse_iso_date(F.col("order_date")).alias("order_date"),
    )


class _Staged(NamedTuple):
    """A checked version of a table that nothing refers to yet."""

    database: str
    table: str
    path: str

    def switch(self, spark: SparkSession) -> int:
        """Make this the current version, in one step, and count its rows.

        Before it the table has all its old rows, after it all its new ones.
        """
        return _switch(spark, self)[0]


def _switch(spark: SparkSession, *staged: _Staged) -> list[int]:
    """Make the staged versions current, all in one step, and count their rows."""
    database = staged[0].database
    _commit(spark, database, {**_committed(spark, database), **{s.table: s.path for s in staged}})
    return [spark.table(f"{database}.{s.table}").count() for s in staged]


def _versions_of(spark: SparkSession, database: str, table: str) -> str:
    """The folder that holds the versions of a table."""
    return f"{_home(spark, database)}/{table}_versions"


def _stage(
    df: DataFrame, database: str, table: str, schema: T.StructType, key: str, required: list[str],
    on_duplicate: str,
) -> _Staged:
    """Write a new version and check it: no NULL where required, unique key."""
    spark = df.sparkSession
    ensure_tables(spark, database)
    _follow_commits(spark, database)
    path = new_version(_versions_of(spark, database, table))
    df.select(*schema.names).write.parquet(path)
    try:
        written = spark.read.schema(schema).parquet(path)
        nulls = written.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
        broken = {c: nulls[c] for c in required if nulls[c]}
        if broken:
            raise LoadError(f"{table}: rows without a required value: {broken}")
        if on_duplicate == "fail":
            repeated = written.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            if not repeated.isEmpty():
                raise LoadError(f"{table}: {key} is not unique")
    except LoadError:
        remove(spark, path)
        raise
    return _Staged(database, table, path)


def _stage_customers(customers: DataFrame, database: str, on_duplicate: str) -> _Staged:
    require_columns(customers, CUSTOMERS_TABLE.names, "clean customers")
    return _stage(
        customers, database, CUSTOMERS, CUSTOMERS_TABLE, "customer_id", ["customer_id"], on_duplicate
    )


def _stage_orders(rollup: DataFrame, database: str, on_null: str, on_duplicate: str) -> _Staged:
    if on_null not in ("fail", "drop"):
        raise ValueError(f"on_null must be 'fail' or 'drop', not {on_null!r}")
    typed = cast_load_types(require_columns(rollup, ORDERS_TABLE.names, "order rollup"))
    if on_null == "drop":
        typed = typed.na.drop()
    return _stage(
        typed, database, ORDERS, ORDERS_TABLE, "order_id", ORDERS_TABLE.names, on_duplicate
    )


def load_customers_full(
    customers: DataFrame, database: str, on_duplicate: str = "fail"
) -> int:
    """Replace the customers table and return the number of rows loaded."""
    return _stage_customers(customers, database, on_duplicate).switch(customers.sparkSession)


def load_orders_full(
    rollup: DataFrame, database: str, on_null: str = "fail", on_duplicate: str = "fail"
) -> int:
    """Replace the orders table and return the number of rows loaded.

    Every column is required.  An order without a customer fails the load, or
    is left out with ``on_null='drop'``.
    """
    return _stage_orders(rollup, database, on_null, on_duplicate).switch(rollup.sparkSession)


def load_all(
    customers: DataFrame,
    rollup: DataFrame,
    database: str,
    on_null: str = "fail",
    on_duplicate: str = "fail",
) -> DataFrame:
    """Load both tables and return (customers_loaded, orders_loaded).

    Both are written and checked, then switched by one commit.
    """
    spark = customers.sparkSession
    staged_customers = _stage_customers(customers, database, on_duplicate)
    staged_orders = _stage_orders(rollup, database, on_null, on_duplicate)
    counts = tuple(_switch(spark, staged_customers, staged_orders))
    return spark.createDataFrame([counts], "customers_loaded bigint, orders_loaded bigint")


def export_jdbc(spark: SparkSession, database: str, url: str, properties: dict[str, str]) -> None:
    """Copy both loaded tables to an external database, replacing its rows.

    The target tables are truncated, not dropped, so their keys and indexes
    stay.  `numPartitions` in the properties bounds the open connections.
    """
    options = {**properties, "truncate": "true"}
    for table in (CUSTOMERS, ORDERS):
        loaded = spark.table(f"{database}.{table}")
        loaded.write.jdbc(url, table, mode="overwrite", properties=options)
