"""Hot keys: one order, number or customer key with a third of all rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest

from kpiloom.operators import dedupe, kpis, orders
from kpiloom.plans import report

AS_OF = datetime(2025, 11, 5)
START = datetime(2025, 9, 1)


@pytest.fixture(scope="module")
def data():
    """Lines of which a third belong to one order and a third to one number."""
    pick = random.Random(11)
    lines = []
    for i in range(9000):
        order = "HOT" if i % 3 == 0 else f"O{pick.randrange(2500)}"
        seed = sum(map(ord, order))
        number = "1" if order == "HOT" or seed % 3 == 1 else f"{seed % 40 + 2}"
        time = START + timedelta(minutes=pick.randrange(90_000))
        lines.append((order, number, time, f"S{pick.randrange(30)}", pick.randrange(5), D(pick.randrange(10_000)) / 100))
    customers = [(f"C{i}", f"n{i}", "1" if i % 3 == 0 else str(pick.randrange(60)), f"r{i % 4}") for i in range(600)]
    customers = list({(c[0], c[2]): c for c in customers}.values())
    return lines, customers


@pytest.fixture(scope="module")
def frames(spark, data):
    lines, customers = data
    return (
        spark.createDataFrame(lines, "order_id string, mobile_number string, order_date_time timestamp_ntz, sku_id string, sku_count int, total_amount decimal(18,2)"),
        spark.createDataFrame(customers, "customer_id string, customer_name string, mobile_number string, region string"),
    )


@pytest.fixture(params=["broadcast", "merge"])
def strategy(spark, request):
    """Both join strategies; the second with adaptive splitting of small partitions."""
    settings = {} if request.param == "broadcast" else {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def brute_grain(lines):
    by_order = defaultdict(list)
    for line in lines:
        by_order[line[0]].append(line)
    return {o: (max((l[2], l[1]) for l in ls)[1], max(l[5] for l in ls), max(l[2] for l in ls)) for o, ls in by_order.items()}


def test_grain(data, frames):
    got = {r.order_id: (r.mobile_number, r.order_amount, r.order_date_time) for r in orders.order_grain(frames[0]).collect()}
    assert got == brute_grain(data[0])


def test_rollup(data, frames, strategy):
    owners = defaultdict(list)
    for customer in data[1]:
        owners[customer[2]].append(customer[0])
    want = defaultdict(lambda: [D(0), None])
    for order, number, time, _, _, amount in data[0]:
        for customer in owners.get(number, [None]):
            entry = want[order, customer]
            entry[0] += amount
            entry[1] = max(entry[1] or time.date(), time.date())
    got = {(r.order_id, r.customer_id): [r.order_amount, r.order_date] for r in orders.order_rollup_sum(*frames).collect()}
    assert got == dict(want)


def brute_report(lines, customers, keep):
    grain = brute_grain(lines)
    owners = defaultdict(list)
    for customer in customers:
        owners[customer[2]].append(customer)
    region, repeat, spend = defaultdict(D), defaultdict(int), defaultdict(D)
    unmatched = [(None, None, None, None)] if keep else []
    for number, amount, time in grain.values():
        for cid, name, _, place in owners.get(number, unmatched):
            region[place] += amount
            repeat[cid] += 1
            if time >= AS_OF - timedelta(days=30):
                spend[cid, name] += amount
    months = defaultdict(set)
    for line in lines:
        months[line[2].strftime("%Y-%m")].add(line[0])
    repeat = {k: v for k, v in repeat.items() if v > 1}
    return (
        {("monthly_order_trend", k, None): len(v) for k, v in months.items()}
        | {("region_revenue", k, None): v for k, v in region.items()}
        | {("repeat_customers", k, None): v for k, v in repeat.items()}
        | {("repeat_customer_count", None, None): len(repeat)}
        | {("top_spenders", *k): v for k, v in spend.items()}
    )


@pytest.mark.parametrize("keep", [False, True])
def test_report(data, frames, strategy, keep):
    got = {(r.kpi, r.key, r.label): r.value for r in report.kpi_report(*frames, AS_OF, keep_unmatched=keep).collect()}
    assert got == {k: float(v) for k, v in brute_report(*data, keep).items()}


def test_hot_number_is_split_in_the_join(frames, strategy, plan, spark):
    if strategy == "broadcast":
        pytest.skip("no shuffle join")
    lines, customers = frames
    wide = customers.unionAll(spark.range(60_000).selectExpr("concat('H', id)", "'n'", "'1'", "concat('r', id % 5)"))
    df = kpis.region_revenue(orders.order_grain(lines), wide)
    df.collect()
    assert "skew=true" in plan(df)


def test_hot_number_is_split_in_the_rollup(frames, strategy, plan, spark):
    if strategy == "broadcast":
        pytest.skip("no shuffle join")
    lines, _ = frames
    customers = spark.range(60).selectExpr("concat('C', id) customer_id", "cast(id as string) mobile_number")
    many = spark.range(40_000).selectExpr(
        "concat('P', id)", "'1'", "timestamp_ntz '2025-10-01 00:00:00'", "'S'", "1", "cast(1 as decimal(18,2))"
    )
    df = orders.order_rollup_sum(lines.unionAll(many), customers)
    df.collect()
    assert "skew=true" in plan(df)


def test_result_depends_on_neither_order_nor_partitions(spark, frames):
    lines, _ = frames
    results = []
    for parts in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        shuffled = lines.repartition(int(parts)).orderBy("total_amount" if parts == "3" else "sku_id")
        for df in (dedupe.dedupe_order_lines(shuffled), orders.order_grain(shuffled, "first"), orders.order_grain(shuffled, "last")):
            results.append(sorted(map(tuple, df.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[:3] == results[3:]
