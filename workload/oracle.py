"""The same results as ANSI SQL over the given tables."""

from workload.views import SQL

_RECENT = "timestamp '2001-08-01' - interval 30 day"


def _amount(expression: str, name: str) -> str:
    return f"cast({expression} as double) as {name}"


_LINE = "order_id, mobile_number, order_date_time, sku_id, sku_count, " + _amount(
    "total_amount", "total_amount"
)
_RAW_LINE = "order_id, mobile_number, order_date_time, sku_id, sku_count, total_amount"
_ROLLUP = "order_id, customer_id, " + _amount("order_amount", "order_amount") + ", order_date"
_YEAR_DAY = "cast(date_trunc('year', arrived) as date) as ingest_date"

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def _title(text: str) -> str:
    words = f"regexp_extract_all({text}, '[{_CASED}]+|[^{_CASED}]+')"
    first = "case when w[1] = 'ß' then 'Ss' else upper(w[1]) end"
    return f"array_to_string(list_transform({words}, lambda w: concat({first}, lower(w[2:]))), '')"


_GRAIN_LINES = """
  select cast(l_orderkey as varchar) as order_id, concat('91', cast(l_suppkey as varchar)) as mobile_number,
         l_shipdate as order_date_time, cast(l_extendedprice as decimal(18,2)) as total_amount
  from lineitem"""


def _grain_pick(direction: str) -> str:
    return f"""
  select order_id, mobile_number, {_amount('total_amount', 'order_amount')}, order_date_time
  from (select *, row_number() over (partition by order_id order by
               order_date_time {direction}, total_amount {direction}, mobile_number {direction}) as rn
        from ({_GRAIN_LINES})) where rn = 1"""


_PER_CUSTOMER = """
  select customer_id, count(*) as order_count from v_rollup {where} group by customer_id"""


def _repeat_rate(where: str) -> str:
    return f"""
  select coalesce(100.0 * count(*) filter (order_count > 1) / nullif(count(*), 0), 0) as repeat_rate
  from ({_PER_CUSTOMER.format(where=where)})"""


_KNOWN = "where customer_id is not null"
_DAILY = "select order_date as day, count(*) as orders from v_rollup group by order_date"
_TOP = """
  select customer_id, cast(sum(order_amount) as double) as revenue from v_rollup {where}
  group by customer_id order by sum(order_amount) desc, customer_id limit 10"""


def _cards(customers: str, rollup: str) -> str:
    """(position, title, value) of the five cards."""
    return f"""
  select 1 as position, 'Total Customers' as title, cast(count(distinct customer_id) as varchar) as value
  from {customers}
  union all select 2, 'Total Orders', cast(count(*) as varchar) from {rollup}
  union all select 3, 'Revenue', format('{{:,.2f}}', cast(coalesce(sum(order_amount), 0) as double)) from {rollup}
  union all select 4, 'Avg Order Value',
         format('{{:,.2f}}', cast(sum(order_amount) as double) / count(order_amount)) from {rollup}
  union all select 5, 'Repeat Customer Rate',
         concat(format('{{:.1f}}', 100.0 * count(*) filter (n > 1) / count(*)), '%')
  from (select count(*) as n from {rollup} where customer_id is not null group by customer_id)"""


def _report(lines: str, customers: str, grain: str) -> str:
    """(kpi, key, label, value) with exact values."""
    return f"""
  select 'monthly_order_trend' as kpi, strftime(order_date_time, '%Y-%m') as key,
         cast(null as varchar) as label, cast(count(distinct order_id) as decimal(28,2)) as value
  from {lines} group by 2
  union all
  select 'region_revenue', region, null, sum(order_amount)
  from {grain} join {customers} using (mobile_number) group by region
  union all
  select 'repeat_customers', customer_id, null, count(distinct order_id)
  from {lines} join {customers} using (mobile_number) group by customer_id having count(distinct order_id) > 1
  union all
  select 'repeat_customer_count', null, null, count(*) from (
    select customer_id from {lines} join {customers} using (mobile_number)
    group by customer_id having count(distinct order_id) > 1)
  union all
  select 'top_spenders', customer_id, customer_name, sum(order_amount)
  from {grain} join {customers} using (mobile_number)
  where order_date_time >= {_RECENT} group by customer_id, customer_name"""


_CLEAN_GRAIN = """(
  select order_id, max(mobile_number) as mobile_number, max(total_amount) as order_amount,
         max(order_date_time) as order_date_time from v_clean_lines group by order_id)"""
_LOADED = "(select * from v_clean_rollup where customer_id is not null)"

_SUMMARY = """
  select (select string_agg(day, ',' order by day) from (
            select distinct strftime(cast(date_trunc('year', arrived) as date), '%Y-%m-%d') as day from v_raw_lines
            union select '2001-08-01' union select '2001-08-02')) as partitions,
         (select count(*) from v_raw_customers) as raw_customers_rows,
         (select count(*) from v_raw_lines) as raw_orders_rows,
         (select count(*) from v_clean_customers) as cleaned_customers_rows,
         (select count(*) from v_clean_lines) as cleaned_orders_rows,
         0 as skipped_files, 0 as blank_mobile_rows,
         (select count(*) from v_raw_lines where try_cast(order_date_time as timestamp) is null) as unparsed_date_rows"""

_DAILY_LINES = f"select {_RAW_LINE}, {_YEAR_DAY} from v_raw_lines"


def _spenders(where: str, kind: str, grain: str = "v_grain", customers: str = "v_customers_part") -> str:
    return f"""
  select customer_id, customer_name, cast(sum(order_amount) as double) as amount
  from {grain} {kind} join {customers} using (mobile_number)
  where {where} group by customer_id, customer_name"""


_REPEAT = """
  select customer_id, count(distinct order_id) as order_count
  from {lines} {kind} join {customers} using (mobile_number)
  group by customer_id having count(distinct order_id) > 1"""

_REGION = """
  select region, cast(sum(order_amount) as double) as revenue
  from {grain} {kind} join {customers} using (mobile_number) group by region"""

_PART = {"lines": "v_lines", "grain": "v_grain", "customers": "v_customers_part"}
_SHARED = {
    "each": {"lines": "v_split_lines", "grain": "v_split_grain", "customers": "v_shared_customers"},
    "once": {"lines": "v_split_lines", "grain": "v_split_grain", "customers": "v_single_customers"},
}


def _placed(body: str, order: str) -> str:
    """The rows of a query with their place in its order."""
    return f"select *, row_number() over (order by {order}) as position from ({body})"

_BODIES: dict[str, str] = {
    # sources
    "scan_customers_csv": "select customer_id, customer_name, mobile_number, region from v_raw_customers",
    "scan_orders_xml": f"select {_RAW_LINE} from v_raw_lines",
    "scan_clean_lines": f"select {_LINE} from v_lines",
    "scan_clean_rollup": f"select {_ROLLUP} from v_rollup",
    "scan_daily_partitions": _DAILY_LINES,
    "scan_daily_customers": "select customer_id, customer_name, mobile_number, region, cast(date '2001-07-31' + cast(copy as integer) as date) as ingest_date from v_raw_customers",
    "scan_daily_incremental": _DAILY_LINES,
    "batch_summary": _SUMMARY,
    "partition_date_ist": "select event_id, cast(ts + interval 330 minute as date) as ingest_date from events",
    "land_batch": f"select {_YEAR_DAY}, count(*) as lines from v_raw_lines group by 1",
    "require_columns": f"select {_ROLLUP} from v_rollup",
    # sinks
    "sink_customers_clean": "select * from v_clean_customers",
    "sink_orders_rollup": f"select {_ROLLUP} from v_rollup",
    "sink_orders_lines": f"select {_LINE} from v_clean_lines",
    "ensure_tables": "select customer_id, customer_name from v_clean_customers",
    "load_customers_full": "select customer_id, customer_name from v_clean_customers",
    "load_orders_full": f"select {_ROLLUP} from v_rollup {_KNOWN}",
    "load_summary": f"""
  select (select count(*) from v_clean_customers) as customers_loaded,
         (select count(*) from v_rollup {_KNOWN}) as orders_loaded""",
    # projections, filters
    "drop_null_customer_keys": "select customer_id, customer_name, mobile_number, region from v_raw_customers where customer_id is not null and mobile_number is not null",
    "drop_null_order_keys": f"""
  select {_RAW_LINE} from v_raw_lines
  where order_id is not null and mobile_number is not null and order_date_time is not null""",
    "drop_unparsed_dates": """
  select order_id, mobile_number, cast(order_date_time as timestamp) as order_date_time, sku_id, sku_count, total_amount
  from v_raw_lines where try_cast(order_date_time as timestamp) is not null""",
    "amount_column_fallback": """
  select order_id, sku_id, cast(coalesce(try_cast(total_amount as decimal(18,2)), 0) as double) as total_amount,
         variant
  from v_raw_lines, (values ('total'), ('order')) as c(variant)
  union all select order_id, sku_id, 0.0, 'none' from v_raw_lines""",
    "lookback_filter": f"select {_LINE} from v_lines where order_date_time >= {_RECENT}",
    "having_min_orders": _PER_CUSTOMER.format(where=_KNOWN) + " having count(*) > 1",
    "project_customer_map": "select customer_id, mobile_number from v_customers",
    "project_rollup": f"""
  select order_id, mobile_number as customer_id, {_amount('total_amount', 'order_amount')},
         cast(order_date_time as date) as order_date from v_lines""",
    # scalar functions
    "trim_text": """
  select customer_id, trim(customer_name) as text from v_raw_customers
  union all
  select cast(doc_id as varchar), regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '', 'g')
  from documents""",
    "title_case": f"""
  select customer_id, {_title('region')} as text from v_raw_customers
  union all select cast(doc_id as varchar), {_title('text')} from documents""",
    "digits_only": r"""
  select customer_id, regexp_replace(mobile_number, '[^\p{Nd}]', '', 'g') as digits from v_raw_customers
  union all select cast(doc_id as varchar), regexp_replace(text, '[^\p{Nd}]', '', 'g') from documents""",
    "safe_timestamp": "select order_id, sku_id, try_cast(order_date_time as timestamp) as moment from v_raw_lines",
    "safe_amount": """
  select order_id, sku_id, cast(coalesce(try_cast(total_amount as decimal(18,2)), 0) as double) as amount
  from v_raw_lines""",
    "to_order_date": "select event_id, cast(ts as date) as order_date from events",
    "parse_iso_date": """
  select order_id, sku_id, cast(try_cast(order_date_time as timestamp) as date) as order_date from v_raw_lines""",
    "year_month": "select event_id, strftime(ts, '%Y-%m') as year_month from events",
    "day_of": "select event_id, cast(ts as date) as day from events",
    "cast_load_types": f"select {_ROLLUP} from v_rollup",
    "zero_if_null": """
  select order_id, sku_id, cast(coalesce(try_cast(total_amount as decimal(18,2)), 0) as double) as amount
  from v_raw_lines""",
    "safe_ratio": """
  select l_orderkey, l_linenumber, coalesce(l_extendedprice / nullif(l_discount, 0), 0.0) as ratio from lineitem""",
    "format_money": "select o_orderkey, format('{:,.2f}', o_totalprice) as money from orders",
    "format_pct": """
  select l_orderkey, l_linenumber, concat(format('{:.1f}', l_discount * 100), '%') as percent,
         concat(format('{:.1f}', l_quantity / 4), '%') as quarters
  from lineitem""",
    # de-duplication
    "dedupe_customers": """
  select customer_id, customer_name, mobile_number, region from (
    select *, row_number() over (partition by customer_id, mobile_number order by customer_name, region) as rn
    from (select customer_id, customer_name, region,
                 regexp_replace(mobile_number, '[^0-9]', '', 'g') as mobile_number from v_raw_customers))
  where rn = 1""",
    "dedupe_order_lines": f"""
  select {_LINE} from (
    select *, row_number() over (partition by order_id, sku_id
              order by order_date_time, mobile_number, sku_count, total_amount) as rn from v_lines)
  where rn = 1""",
    "dedupe_orders_without_sku": f"""
  select order_id, mobile_number, order_date_time, sku_count, {_amount('total_amount', 'total_amount')} from (
    select *, row_number() over (partition by order_id
              order by order_date_time, mobile_number, sku_count, total_amount) as rn from v_lines)
  where rn = 1""",
    "order_grain_max": f"""
  select order_id, max(mobile_number) filter (latest = 1) as mobile_number,
         cast(max(total_amount) as double) as order_amount, max(order_date_time) as order_date_time
  from (select *, rank() over (partition by order_id order by order_date_time desc) as latest
        from ({_GRAIN_LINES})) group by order_id""",
    "order_grain_first": _grain_pick("asc"),
    "order_grain_last": _grain_pick("desc"),
    # joins
    "join_lines_customer_id_left": f"""
  select {_LINE}, customer_id from v_lines left join v_customers_part using (mobile_number)""",
    "join_lines_customers_left": f"""
  select {_LINE}, customer_id, customer_name, region
  from v_lines left join v_customers_part using (mobile_number)""",
    "join_grain_customers_inner": f"""
  select order_id, mobile_number, {_amount('order_amount', 'order_amount')}, order_date_time,
         customer_id, customer_name, region
  from v_grain join v_customers_part using (mobile_number)""",
    "join_lines_customers_inner": f"""
  select {_LINE}, customer_id, customer_name, region
  from v_lines join v_customers_part using (mobile_number)""",
    # aggregates
    "order_rollup_sum": f"select {_ROLLUP} from v_rollup",
    "total_customers_distinct": "select count(distinct customer_id) as total_customers from v_raw_customers",
    "total_customers_rows": "select count(*) as total_customers from v_raw_customers",
    "total_customers_with_null": "select count(*) as total_customers from (select distinct customer_id from v_rollup)",
    "total_orders": "select count(*) as total_orders, count(order_id) as identified_orders from v_rollup",
    "total_revenue": "select coalesce(cast(sum(order_amount) as double), 0) as revenue from v_rollup",
    "avg_order_value": """
  select coalesce(cast(sum(order_amount) as double) / count(order_amount), 0) as avg_order_value from v_rollup""",
    "avg_order_value_per_row": """
  select coalesce(cast(sum(order_amount) as double) / count(*), 0) as avg_order_value from v_rollup""",
    "orders_per_customer": _PER_CUSTOMER.format(where=_KNOWN),
    "orders_per_customer_keep_unmatched": _PER_CUSTOMER.format(where=""),
    "repeat_rate": _repeat_rate(_KNOWN),
    "repeat_rate_keep_unmatched": _repeat_rate(""),
    "daily_orders": _DAILY,
    "daily_orders_filled": f"""
  select cast(d.day as date) as day, coalesce(n.orders, 0) as orders
  from (select unnest(generate_series(min(order_date), max(order_date), interval 1 day)) as day from v_rollup) d
  left join ({_DAILY}) n on n.day = cast(d.day as date)""",
    "top_customers_10": _TOP.format(where=_KNOWN),
    "top_customers_10_keep_unmatched": _TOP.format(where=""),
    "monthly_order_trend": """
  select strftime(order_date_time, '%Y-%m') as year_month, count(distinct order_id) as order_count
  from v_lines group by 1""",
    "region_revenue": _REGION.format(kind="", **_PART),
    "region_revenue_keep_unmatched": _REGION.format(kind="left", **_PART),
    "repeat_customers": _REPEAT.format(kind="", **_PART),
    "repeat_customers_keep_unmatched": _REPEAT.format(kind="left", **_PART),
    "repeat_customer_count": f"select count(*) as repeat_customer_count from ({_REPEAT.format(kind='', **_PART)})",
    "top_spenders": _spenders(f"order_date_time >= {_RECENT}", ""),
    "top_spenders_of_grain": _spenders(f"order_date_time >= {_RECENT}", ""),
    **{f"region_revenue_shared_{n}": _REGION.format(kind="", **v) for n, v in _SHARED.items()},
    **{f"repeat_customers_shared_{n}": _REPEAT.format(kind="", **v) for n, v in _SHARED.items()},
    **{f"top_spenders_shared_{n}": _spenders(f"order_date_time >= {_RECENT}", "", v["grain"], v["customers"]) for n, v in _SHARED.items()},
    **{f"kpi_report_shared_{n}": f"select kpi, key, label, cast(value as double) as value from ({_report(v['lines'], v['customers'], v['grain'])})" for n, v in _SHARED.items()},
    "top_spenders_recent_lines": _spenders(f"order_date_time >= {_RECENT}", "left"),
    # sorts, set operations
    "sort_desc_amount": _placed(f"""
  select customer_id, cast(sum(order_amount) as double) as revenue from v_rollup {_KNOWN} group by customer_id""", "revenue desc, customer_id"),
    "sort_asc_period": _placed("""
  select strftime(order_date_time, '%Y-%m') as year_month, count(*) as orders from v_grain group by 1""", "year_month"),
    "top_k": _placed("""
  select order_id, cast(order_amount as double) as order_amount from v_grain
  order by v_grain.order_amount desc, order_id limit 10""", "order_amount desc, order_id"),
    "daily_orders_in_order": _placed(_DAILY, "day"),
    "region_revenue_in_order": _placed(_REGION.format(kind="", **_PART), "revenue desc, region"),
    "union_batches": """
  select customer_id, customer_name, mobile_number, region from v_raw_customers
  union all select customer_id, customer_name, mobile_number, region from v_raw_customers
  union all select customer_id, customer_name, mobile_number, null from v_raw_customers""",
    # reports and jobs
    "clean_customers": "select * from v_clean_customers",
    "kpi_report_ranked": f"""
  select kpi, key, label, cast(value as double) as value,
         row_number() over (partition by kpi order by case when kpi = 'monthly_order_trend' then 0 else -value end, key, label) as rank
  from ({_report('v_lines', 'v_customers_part', 'v_grain')})""",
    "merge_new_batches": _SUMMARY,
    "clean_orders": f"select {_LINE} from v_clean_lines",
    "kpi_cards": _cards("v_customers", "v_rollup"),
    "chart_daily_orders": _DAILY,
    "chart_top_customers": _TOP.format(where=_KNOWN),
    "kpi_bundle": f"""
  select 'spark' as engine,
    (select cast(to_json(list({{'title': title, 'value': value}} order by position)) as varchar)
     from ({_cards('v_customers', 'v_rollup')})) as cards,
    concat('[{{"id":"orders_daily","title":"Orders per Day","points":',
      (select cast(to_json(list({{'label': cast(day as varchar), 'value': cast(orders as decimal(28,2))}} order by day))
                   as varchar) from ({_DAILY})),
      '}},{{"id":"top_customers","title":"Top 10 Customers by Revenue","points":',
      (select cast(to_json(list({{'label': customer_id, 'value': cast(revenue as decimal(28,2))}}
                                order by revenue desc, customer_id)) as varchar)
       from ({_TOP.format(where=_KNOWN)})), '}}]') as charts""",
    "kpi_report": f"""
  select kpi, key, label, cast(value as double) as value from ({_report('v_lines', 'v_customers_part', 'v_grain')})""",
    "merge_and_clean_batches": _SUMMARY,
    "run_job": f"""
  select 'raw_customers_rows' as title, cast(count(*) as varchar) as value from v_raw_customers
  union all select 'raw_orders_rows', cast(count(*) as varchar) from v_raw_lines
  union all select 'cleaned_customers_rows', cast(count(*) as varchar) from v_landed_customers
  union all select 'cleaned_orders_rows', cast(count(*) as varchar) from v_clean_lines
  union all select 'skipped_files', '0' union all select 'blank_mobile_rows', '0'
  union all select 'unparsed_date_rows', cast(count(*) as varchar) from v_raw_lines where try_cast(order_date_time as timestamp) is null
  union all select 'customers_loaded', cast(count(*) as varchar) from v_landed_customers
  union all select 'orders_loaded', cast(count(*) as varchar) from {_LOADED}
  union all select title, value from ({_cards('v_landed_customers', _LOADED)})
  union all select concat_ws('/', kpi, key, label), cast(cast(value as decimal(28,2)) as varchar)
  from ({_report('v_clean_lines', 'v_landed_customers', _CLEAN_GRAIN)})""",
}

_BODIES["run_pipeline"] = _BODIES["run_job"]

ORACLE: dict[str, str] = {name: f"with {SQL}\n{body}" for name, body in _BODIES.items()}
