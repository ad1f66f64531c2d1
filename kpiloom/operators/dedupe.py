"""Keep-first de-duplication with a defined winner.

The winner is the least record in a stated order, found by ``min(struct)``.  It
combines on the map side, so a key that holds a third of all rows reaches its
reducer as one record per map task.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Position of a row in the raw input; the batch readers attach it.
INPUT_ORDER = "input_order"


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key (NULL is a key too), the first by ``order_by``.

    Ties are settled by the remaining columns from left to right, so the result
    depends neither on the partitioning nor on the order of the rows.
    """
    first = [name for name in order_by if name in df.columns and name not in keys]
    rest = [name for name in df.columns if name not in keys and name not in first]
    if not first + rest:
        return df.select(*keys).distinct()
    winner = F.min(F.struct(*first, *rest)).alias("winner")
    return (
        df.groupBy(*keys)
        .agg(winner)
        .select(*[F.col(c) if c in keys else F.col(f"winner.{c}").alias(c) for c in df.columns])
    )


def dedupe_customers(customers: DataFrame) -> DataFrame:
    """One row per customer and mobile number."""
    return keep_first(
        customers, ["customer_id", "mobile_number"], order_by=[INPUT_ORDER, "ingest_date"]
    )


def dedupe_order_lines(lines: DataFrame) -> DataFrame:
    """One row per order and SKU, or per order where there is no SKU column."""
    keys = [name for name in ("order_id", "sku_id") if name in lines.columns]
    return keep_first(
        lines, keys, order_by=[INPUT_ORDER, "ingest_date", "order_date_time"]
    )
