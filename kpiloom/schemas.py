"""Explicit schemas of every dataset, so that no reader infers a type."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


RAW_CUSTOMERS = _text("customer_id", "customer_name", "mobile_number", "region")

# Raw lines are read as text throughout: a bad number or date must cost one
# value, not the record or the file.
RAW_ORDER_LINES = _text(
    "order_id", "mobile_number", "order_date_time", "sku_id", "sku_count", "total_amount"
)

CLEAN_CUSTOMERS = RAW_CUSTOMERS

CLEAN_ORDER_LINES = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("mobile_number", T.StringType()),
        T.StructField("order_date_time", T.TimestampNTZType()),
        T.StructField("sku_id", T.StringType()),
        T.StructField("sku_count", T.IntegerType()),
        T.StructField("total_amount", MONEY),
    ]
)

ORDER_ROLLUP = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_amount", MONEY),
        T.StructField("order_date", T.DateType()),
    ]
)

CUSTOMERS_TABLE = _text("customer_id", "customer_name")
ORDERS_TABLE = ORDER_ROLLUP

# Folder column of the written order datasets.
MONTH_COLUMN = "order_month"
