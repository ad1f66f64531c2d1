"""The engine's datasets as views over the given tables, in Spark and in SQL.

Order totals are repeated on every line, as raw order files have them.  The
`raw` views dirty the values: missing numbers, bad dates and amounts, odd case
and spacing, and a second copy of every customer under another name, which
arrives a day later.  In the `part` view the customers with a negative balance
have another number, so that their orders find no customer.  In the `shared`
view every fifth customer has the number of the one before, and in the `split`
view some orders have lines on two numbers.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.schemas import MONEY

SQL = """
v_base_customers as (
  select concat('CUST-', lpad(cast(c_custkey as varchar), 12, '0')) as customer_id,
         c_name as customer_name,
         concat('91', lpad(cast(c_custkey as varchar), 12, '0')) as mobile_number,
         r_name as region,
         c_custkey as k, c_acctbal as balance
  from customer join nation on c_nationkey = n_nationkey
                join region on n_regionkey = r_regionkey),
v_customers as (
  select customer_id, customer_name, mobile_number, region from v_base_customers),
v_customers_part as (
  select customer_id, customer_name,
         case when balance < 0 then concat('92', substr(mobile_number, 3)) else mobile_number end as mobile_number, region
  from v_base_customers),
v_base_lines as (
  select concat('ORD-', lpad(cast(o_orderkey as varchar), 12, '0')) as order_id,
         concat('91', lpad(cast(o_custkey as varchar), 12, '0')) as mobile_number,
         o_orderdate as order_date_time,
         concat('SKU-', cast(l_partkey as varchar)) as sku_id,
         cast(l_quantity as integer) as sku_count,
         cast(o_totalprice as decimal(18,2)) as total_amount,
         o_orderkey as k
  from lineitem join orders on l_orderkey = o_orderkey),
v_lines as (
  select order_id, mobile_number, order_date_time, sku_id, sku_count, total_amount from v_base_lines),
v_raw_customers as (
  select customer_id, concat('  ', upper(customer_name), ' ') as customer_name,
         case when k % 13 = 0 then null
              else concat('+', left(mobile_number, 2), '-', substr(mobile_number, 3)) end as mobile_number,
         concat(' ', lower(region)) as region, 1 as copy
  from v_base_customers
  union all
  select customer_id, concat('a ', lower(customer_name)) as customer_name,
         case when k % 13 = 0 then null
              else concat('+', left(mobile_number, 2), ' ', substr(mobile_number, 3)) end as mobile_number,
         upper(region) as region, 2 as copy
  from v_base_customers),
v_raw_lines as (
  select order_id,
         case when k % 101 = 0 then null
              else concat('+', left(mobile_number, 2), ' ', substr(mobile_number, 3)) end as mobile_number,
         case when k % 89 = 0 then 'not-a-date'
              else strftime(order_date_time, '%Y-%m-%dT%H:%M:%S') end as order_date_time,
         sku_id, cast(sku_count as varchar) as sku_count,
         case when k % 97 = 0 then 'unknown' else cast(total_amount as varchar) end as total_amount,
         order_date_time as arrived
  from v_base_lines),
v_clean_customers as (
  select customer_id,
         array_to_string(list_transform(string_split(trim(customer_name), ' '),
             lambda w: concat(upper(left(w, 1)), lower(substr(w, 2)))), ' ') as customer_name,
         regexp_replace(mobile_number, '[^0-9]', '', 'g') as mobile_number,
         array_to_string(list_transform(string_split(trim(region), ' '),
             lambda w: concat(upper(left(w, 1)), lower(substr(w, 2)))), ' ') as region
  from v_raw_customers where mobile_number is not null and copy = 2),
v_landed_customers as (
  select customer_id,
         array_to_string(list_transform(string_split(trim(customer_name), ' '),
             lambda w: concat(upper(left(w, 1)), lower(substr(w, 2)))), ' ') as customer_name,
         regexp_replace(mobile_number, '[^0-9]', '', 'g') as mobile_number,
         array_to_string(list_transform(string_split(trim(region), ' '),
             lambda w: concat(upper(left(w, 1)), lower(substr(w, 2)))), ' ') as region
  from v_raw_customers where mobile_number is not null and copy = 1),
v_typed_lines as (
  select order_id, regexp_replace(mobile_number, '[^0-9]', '', 'g') as mobile_number,
         try_cast(order_date_time as timestamp) as order_date_time, sku_id,
         try_cast(sku_count as integer) as sku_count,
         coalesce(try_cast(total_amount as decimal(18,2)), 0) as total_amount
  from v_raw_lines where mobile_number is not null),
v_clean_lines as (
  select order_id, mobile_number, order_date_time, sku_id, sku_count, total_amount
  from (select *, row_number() over (partition by order_id, sku_id
                 order by order_date_time, mobile_number, sku_count, total_amount) as rn
        from v_typed_lines where order_date_time is not null)
  where rn = 1),
v_grain as (
  select order_id, max(mobile_number) as mobile_number, max(total_amount) as order_amount,
         max(order_date_time) as order_date_time
  from v_lines group by order_id),
v_rollup as (
  select order_id, customer_id, sum(total_amount) as order_amount,
         cast(max(order_date_time) as date) as order_date
  from v_lines left join v_customers_part using (mobile_number)
  group by order_id, customer_id),
v_shared_customers as (
  select customer_id, customer_name,
         case when k % 5 = 0 then concat('91', lpad(cast(k - 1 as varchar), 12, '0')) else mobile_number end as mobile_number, region
  from v_base_customers),
v_number_owners as (
  select mobile_number, min(customer_id) as customer_id from v_shared_customers group by mobile_number),
v_single_customers as (
  select v_shared_customers.* from v_shared_customers join v_number_owners using (mobile_number, customer_id)),
v_split_lines as (
  select order_id,
         case when k % 7 = 0 and cast(substr(sku_id, 5) as bigint) % 2 = 0
              then concat('91', lpad(cast(cast(substr(mobile_number, 3) as bigint) + 1 as varchar), 12, '0'))
              else mobile_number end as mobile_number,
         order_date_time, sku_id, sku_count, total_amount
  from v_base_lines),
v_split_grain as (
  select order_id, max(mobile_number) as mobile_number, max(total_amount) as order_amount,
         max(order_date_time) as order_date_time
  from v_split_lines group by order_id),
v_clean_rollup as (
  select order_id, customer_id, sum(total_amount) as order_amount,
         cast(max(order_date_time) as date) as order_date
  from v_clean_lines left join v_landed_customers using (mobile_number)
  group by order_id, customer_id)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), 12, "0"))


def _base_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer")
    return customers.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        _id("CUST-", "c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        _id("91", "c_custkey").alias("mobile_number"),
        F.col("r_name").alias("region"),
        F.col("c_custkey").alias("k"),
        F.col("c_acctbal").alias("balance"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base_customers(spark, sf_dir).drop("k", "balance")


def customers_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base_customers(spark, sf_dir)
    other = F.overlay("mobile_number", F.lit("92"), 1, 2)
    number = F.when(F.col("balance") < 0, other).otherwise(F.col("mobile_number"))
    return base.withColumn("mobile_number", number).drop("k", "balance")


def _base_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        _id("ORD-", "o_orderkey").alias("order_id"),
        _id("91", "o_custkey").alias("mobile_number"),
        F.col("o_orderdate").alias("order_date_time"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        F.col("o_orderkey").alias("k"),
    )


def _with_items(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """What depends on the order alone is computed once per order, below the join.

    Orders and items grow together, so neither is ever to be broadcast.
    """
    items = table(spark, sf_dir, "lineitem").hint("merge")
    return items.join(orders, F.col("l_orderkey") == F.col("k")).select(
        "order_id",
        "mobile_number",
        "order_date_time",
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku_id"),
        F.col("l_quantity").cast("int").alias("sku_count"),
        "total_amount",
        *[name for name in orders.columns if name not in ("order_id", "mobile_number", "order_date_time", "total_amount")],
    )


def _base_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_items(spark, sf_dir, _base_orders(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base_lines(spark, sf_dir).drop("k")


def shared_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base_customers(spark, sf_dir)
    neighbour = F.concat(F.lit("91"), F.lpad((F.col("k") - 1).cast("string"), 12, "0"))
    number = F.when(F.col("k") % 5 == 0, neighbour).otherwise(F.col("mobile_number"))
    return base.withColumn("mobile_number", number).drop("k", "balance")


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.right("mobile_number", F.length("mobile_number") - 2).cast("bigint")
    neighbour = F.concat(F.lit("91"), F.lpad((digits + 1).cast("string"), 12, "0"))
    moved = (F.col("k") % 7 == 0) & (F.substring_index("sku_id", "-", -1).cast("bigint") % 2 == 0)
    number = F.when(moved, neighbour).otherwise(F.col("mobile_number"))
    return _base_lines(spark, sf_dir).withColumn("mobile_number", number).drop("k")


def _written_number(separator: str) -> Column:
    number = F.col("mobile_number")
    return F.concat(
        F.lit("+"), F.left(number, F.lit(2)), F.lit(separator), F.right(number, F.length(number) - 2)
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = raw_customer_copies(spark, sf_dir)
    return first.unionByName(second)


def raw_customer_copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = _base_customers(spark, sf_dir)

    def copy(name: Column, separator: str, region: Column) -> DataFrame:
        return base.select(
            "customer_id",
            name.alias("customer_name"),
            F.when(F.col("k") % 13 != 0, _written_number(separator)).alias("mobile_number"),
            region.alias("region"),
        )

    name, region = F.col("customer_name"), F.col("region")
    padded = F.concat(F.lit("  "), F.upper(name), F.lit(" "))
    first = copy(padded, "-", F.concat(F.lit(" "), F.lower(region)))
    return first, copy(F.concat(F.lit("a "), F.lower(name)), " ", F.upper(region))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirtied lines as text, with the moment of the order as `arrived`."""
    moment = F.date_format("order_date_time", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("k")
    orders = _base_orders(spark, sf_dir).select(
        "order_id",
        F.when(k % 101 != 0, _written_number(" ")).alias("mobile_number"),
        F.when(k % 89 == 0, "not-a-date").otherwise(moment).alias("order_date_time"),
        F.when(k % 97 == 0, "unknown")
        .otherwise(F.col("total_amount").cast("string"))
        .alias("total_amount"),
        F.col("order_date_time").alias("arrived"),
        "k",
    )
    return _with_items(spark, sf_dir, orders).select(
        "order_id", "mobile_number", "order_date_time", "sku_id", F.col("sku_count").cast("string").alias("sku_count"), "total_amount", "arrived"
    )
