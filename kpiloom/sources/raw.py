"""Single raw datasets of one layout."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions import null_if_missing
from kpiloom.schemas import RAW_CUSTOMERS, RAW_ORDER_LINES

# The XML element of one order line, the alternate amount column.
ROW_TAG = "order"
ALTERNATE_AMOUNT = "order_amount"

# A quote inside a quoted field is doubled, and white space is data.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

ORDER_FIELDS = T.StructType(
    RAW_ORDER_LINES.fields + [T.StructField(ALTERNATE_AMOUNT, T.StringType())]
)


def blank_missing(df: DataFrame, names: list[str]) -> DataFrame:
    """NULL instead of the missing-value tokens in the named text columns."""
    return df.withColumns({name: null_if_missing(F.col(name)) for name in names})


def resolve_amount(lines: DataFrame) -> DataFrame:
    """Fold the alternate amount column into ``total_amount``."""
    merged = F.coalesce(F.col("total_amount"), F.col(ALTERNATE_AMOUNT))
    return lines.withColumn("total_amount", merged).drop(ALTERNATE_AMOUNT)


def scan_customers_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Customers from headered CSV with the columns in the schema's order.

    A schema binds CSV columns by position, so a header in another order is an
    error here; ``landing.read_customer_batches`` aligns such files by name.

    A file is cut at its line ends, which a quoted value may hold too.  So the
    lines are looked at first, and if any has an odd number of quotes, every file
    is read whole by one task.
    """
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    paths = [path] if isinstance(path, str) else path
    whole = not spark.read.text(paths).filter(odd).isEmpty()
    reader = spark.read.options(enforceSchema="false", multiLine=str(whole).lower(), **CSV_OPTIONS)
    return blank_missing(reader.schema(RAW_CUSTOMERS).csv(path), RAW_CUSTOMERS.names)
