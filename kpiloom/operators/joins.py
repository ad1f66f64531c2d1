"""Joins of orders with customers, all on the mobile number.

No join carries a broadcast hint.  Spark broadcasts the customers when their
size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and
merges, where adaptive execution splits a hot number across tasks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.filters import project_customer_map

MOBILE = "mobile_number"


def join_customer_id(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """Lines with the customer id; NULL where no customer has the number."""
    return lines.join(project_customer_map(customers), MOBILE, "left")


def join_customers(orders: DataFrame, customers: DataFrame, how: str = "left") -> DataFrame:
    """Orders (lines or one row each) with the whole customer row.

    Other columns that both sides have get ``_order`` and ``_customer``.
    """
    shared = [c for c in orders.columns if c in customers.columns and c != MOBILE]
    left = orders.withColumnsRenamed({c: f"{c}_order" for c in shared})
    right = customers.withColumnsRenamed({c: f"{c}_customer" for c in shared})
    return left.join(right, MOBILE, how)


def number_owners(customers: DataFrame, shared_number: str = "each") -> DataFrame:
    """The customers that a number counts for.

    ``each``: all that have it, so an order on a shared number counts for each
    of them.  ``once``: the one with the least id (then the least of the other
    columns), so every order counts once.
    """
    if shared_number not in ("each", "once"):
        raise ValueError(f"shared_number must be 'each' or 'once', not {shared_number!r}")
    if shared_number == "each":
        return customers
    rest = ["customer_id", *[c for c in customers.columns if c not in (MOBILE, "customer_id")]]
    owner = F.min(F.struct(*[c for c in rest if c in customers.columns])).alias("owner")
    return customers.groupBy(MOBILE).agg(owner).select(MOBILE, "owner.*").select(*customers.columns)


def join_totals(totals: DataFrame, customers: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Totals per mobile number with their customers.

    ``totals`` is unique on the number, so the join emits one row per customer.
    A number may still belong to very many customers.  Adaptive execution splits
    such a number only in an inner join that an exchange feeds on both sides,
    hence two things:

    * the join has a second key, implied by the first.  Without it the planner
      would reuse the partitioning of the aggregate behind ``totals``;
    * the numbers that no customer has come from an anti-join with the distinct
      numbers, not from an outer join.
    """
    digits = F.length(MOBILE).alias("digits")
    matched = totals.select("*", digits).join(customers.select("*", digits), [MOBILE, "digits"])
    matched = matched.drop("digits")
    if not keep_unmatched:
        return matched
    unmatched = totals.join(customers.select(MOBILE).distinct(), MOBILE, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)
