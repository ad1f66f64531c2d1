import json
from datetime import datetime, timedelta, timezone
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from golden import AS_OF, CUSTOMERS, LINES, ORDERS, customers_csv, orders_xml
from kpiloom.operators import kpis, orders
from kpiloom.plans import dashboard, jobs, report
from kpiloom.plans.clean import clean_customers, clean_orders
from kpiloom.sinks import files, tables
from kpiloom.sources.clean import (
    scan_clean_customers,
    scan_clean_lines,
    scan_clean_rollup,
    scan_recent_lines,
)
from kpiloom.sources.landing import BadFileError
from test_landing import put


@pytest.fixture(scope="module")
def golden(spark):
    customers = spark.createDataFrame(CUSTOMERS, "customer_id string, customer_name string, mobile_number string, region string")
    raw = spark.createDataFrame(LINES, "order_id string, mobile_number string, order_date_time string, sku_id string, sku_count string, total_amount string")
    return clean_customers(customers), clean_orders(raw)


@pytest.fixture
def database(spark, tmp_path):
    name = f"db_{abs(hash(str(tmp_path)))}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    return name


def test_golden_rollup_and_grain(golden):
    customers, lines = golden
    rollup = {(r.order_id, r.customer_id): r.order_amount for r in orders.order_rollup_sum(lines, customers).collect()}
    assert rollup == {
        ("R10", "K1"): D("241.00"),
        ("R11", "K1"): D("240.00"),
        ("R12", "K2"): D("181.00"),
        ("R12", "K4"): D("181.00"),
        ("R13", "K5"): D("600.00"),
        ("R14", "K5"): D("64.00"),
        ("R14", "K1"): D("64.00"),
    }
    for how in ("max", "first", "last"):
        grain = {r.order_id: r.order_amount for r in orders.order_grain(lines, how).collect()}
        assert grain == {name: D(amount) for name, (amount, _) in ORDERS.items()}


def test_golden_dashboard(golden):
    customers, lines = golden
    rollup = orders.order_rollup_sum(lines, customers)
    cards = [(r.title, r.value) for r in dashboard.kpi_cards(customers, rollup).orderBy("position").collect()]
    assert cards == [
        ("Total Customers", "5"),
        ("Total Orders", "7"),
        ("Revenue", "1,571.00"),
        ("Avg Order Value", "224.43"),
        ("Repeat Customer Rate", "50.0%"),
    ]
    assert [tuple(r) for r in dashboard.chart_top_customers(rollup).collect()] == [("K5", 664.0), ("K1", 545.0), ("K2", 181.0), ("K4", 181.0)]
    filled = kpis.daily_orders_filled(rollup).collect()
    assert (len(filled), sum(r.orders > 0 for r in filled), str(filled[0].day)) == (56, 5, "2024-04-11")
    bundle = dashboard.kpi_bundle(customers, rollup).first()
    assert [(c.title, c.value) for c in bundle.cards] == cards
    assert [[p.label for p in c.points] for c in bundle.charts] == [
        ["2024-04-11", "2024-05-20", "2024-06-01", "2024-06-02", "2024-06-05"],
        ["K5", "K1", "K2", "K4"],
    ]


GOLDEN_REPORT = {
    ("monthly_order_trend", "2024-04", None, 1.0),
    ("monthly_order_trend", "2024-05", None, 2.0),
    ("monthly_order_trend", "2024-06", None, 3.0),
    ("region_revenue", "Harbour", None, 264.5),
    ("region_revenue", "Valley", None, 345.25),
    ("region_revenue", "Ridge", None, 45.25),
    ("repeat_customers", "K1", None, 3.0),
    ("repeat_customers", "K5", None, 2.0),
    ("repeat_customer_count", None, None, 2.0),
    ("top_spenders", "K1", "Mira Stone", 264.5),
    ("top_spenders", "K5", "Olga Brandt", 300.0),
}


def test_golden_report(golden):
    customers, lines = golden
    assert {tuple(r) for r in report.kpi_report(lines, customers, AS_OF).collect()} == GOLDEN_REPORT


def test_an_order_on_a_shared_number_counts_once(golden):
    customers, lines = golden
    got = {tuple(r) for r in report.kpi_report(lines, customers, AS_OF, shared_number="once").collect()}
    assert got == GOLDEN_REPORT - {("region_revenue", "Ridge", None, 45.25)}
    grain = orders.order_grain(lines)
    assert [tuple(r) for r in kpis.region_revenue(grain, customers, shared_number="once").collect()] == [("Valley", 345.25), ("Harbour", 264.5)]
    with pytest.raises(ValueError, match="shared_number"):
        kpis.region_revenue(grain, customers, shared_number="twice")


def test_repeat_customers_on_lines_and_on_grain(golden):
    customers, lines = golden
    assert sorted(map(tuple, kpis.repeat_customers(lines, customers).collect())) == [("K1", 3), ("K5", 2)]
    assert sorted(map(tuple, kpis.repeat_customers(orders.order_grain(lines), customers).collect())) == [("K1", 3)]


def test_ranked_report(golden):
    customers, lines = golden
    got = sorted((r.kpi, r["rank"], r.key) for r in report.ranked(report.kpi_report(lines, customers, AS_OF)).collect())
    assert got == [
        ("monthly_order_trend", 1, "2024-04"), ("monthly_order_trend", 2, "2024-05"), ("monthly_order_trend", 3, "2024-06"),
        ("region_revenue", 1, "Valley"), ("region_revenue", 2, "Harbour"), ("region_revenue", 3, "Ridge"),
        ("repeat_customer_count", 1, None), ("repeat_customers", 1, "K1"), ("repeat_customers", 2, "K5"),
        ("top_spenders", 1, "K5"), ("top_spenders", 2, "K1"),
    ]


def test_look_back_on_lines_or_on_orders(spark, golden):
    """R13 has one line before the cutoff and one after it."""
    customers, lines = golden
    as_of = datetime(2024, 7, 1)
    both = spark.createDataFrame([("X", "4700003", datetime(2024, 5, 1), "S", 1, D("9")), ("X", "4700003", datetime(2024, 6, 15), "T", 1, D("5"))], lines.schema)
    assert [r.amount for r in kpis.top_spenders(both, customers, as_of).collect()] == [5.0]
    assert [r.amount for r in kpis.spenders_of_grain(orders.order_grain(both), customers, as_of).collect()] == [9.0]
    india = timezone(timedelta(hours=5, minutes=30))
    late = datetime(2024, 7, 15, 5, 30, tzinfo=india)  # midnight in UTC
    assert kpis.top_spenders(both, customers, late).count() == 1
    assert kpis.top_spenders(both, customers, late + timedelta(seconds=1)).count() == 0


def test_report_agrees_with_the_single_figures(spark, golden):
    customers, lines = golden
    part = customers.filter("customer_id <> 'K2'")
    grain = orders.order_grain(lines)
    for keep in (False, True):
        got = report.kpi_report(lines, part, AS_OF, keep_unmatched=keep)
        value = {(r.kpi, r.key): r.value for r in got.collect()}
        for r in kpis.region_revenue(grain, part, keep).collect():
            assert value.pop(("region_revenue", r.region)) == r.revenue
        for r in kpis.repeat_customers(lines, part, keep).collect():
            assert value.pop(("repeat_customers", r.customer_id)) == r.order_count
        for r in kpis.spenders_of_grain(grain, part, AS_OF, keep_unmatched=keep).collect():
            assert value.pop(("top_spenders", r.customer_id)) == r.amount
        assert {k for k, _ in value} == {"monthly_order_trend", "repeat_customer_count"}


def test_figures_of_an_empty_dashboard(spark, golden):
    customers, lines = (df.limit(0) for df in golden)
    rollup = orders.order_rollup_sum(lines, customers)
    values = [r.value for r in dashboard.kpi_cards(customers, rollup).orderBy("position").collect()]
    assert values == ["0", "0", "0.00", "0.00", "0.0%"]
    text = dashboard.bundle_to_json(dashboard.kpi_bundle(customers, rollup)).first()
    assert [c["points"] for c in json.loads(text.charts)] == [[], []]


def test_written_lines_prune_months(spark, golden, tmp_path, plan):
    _, lines = golden
    files.sink_orders_lines(lines, str(tmp_path / "lines"))
    assert sorted(map(tuple, scan_clean_lines(spark, str(tmp_path / "lines")).collect())) == sorted(map(tuple, lines.collect()))
    recent = scan_recent_lines(spark, str(tmp_path / "lines"), AS_OF)
    assert {r.order_id for r in recent.collect()} == {"R10", "R11", "R13", "R14"}
    assert "order_month" in plan(recent).split("PartitionFilters")[1].split("PushedFilters")[0]


def test_csv_round_trip(spark, golden, tmp_path):
    customers, lines = golden
    rollup = orders.order_rollup_sum(lines, customers)
    for name, df, sink, scan in (
        ("c", customers, files.sink_customers_clean, scan_clean_customers),
        ("l", lines, files.sink_orders_lines, scan_clean_lines),
        ("r", rollup, files.sink_orders_rollup, scan_clean_rollup),
    ):
        sink(df, str(tmp_path / name), "csv")
        back = scan(spark, str(tmp_path / name), "csv")
        assert back.dtypes == df.select(*back.columns).dtypes
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select(*back.columns).collect()))


def test_plain_csv_files_are_typed_by_the_schema(spark, tmp_path):
    """Files as a single-node tool writes them: a space in times, floats as amounts."""
    (tmp_path / "r.csv").write_text("order_id,customer_id,order_amount,order_date\nO1,C1,22350.0,2025-10-12\nO2,,5.5,2025-10-13\n")
    assert [tuple(map(str, r)) for r in scan_clean_rollup(spark, str(tmp_path / "r.csv"), "csv").collect()] == [
        ("O1", "C1", "22350.00", "2025-10-12"),
        ("O2", "None", "5.50", "2025-10-13"),
    ]
    (tmp_path / "l.csv").write_text(
        "order_id,mobile_number,order_date_time,sku_id,sku_count,total_amount\nO1,0912,2025-10-12 09:15:32,S,2,7450.0\n"
    )
    assert [tuple(map(str, r)) for r in scan_clean_lines(spark, str(tmp_path / "l.csv"), "csv").collect()] == [
        ("O1", "0912", "2025-10-12 09:15:32", "S", "2", "7450.00")
    ]


# -- tables ----------------------------------------------------------------------


def test_load_replaces_and_is_idempotent(spark, golden, database):
    customers, lines = golden
    rollup = orders.order_rollup_sum(lines, customers)
    for _ in range(2):
        assert tuple(tables.load_all(customers, rollup, database, on_duplicate="keep").first()) == (5, 7)
    assert spark.table(f"{database}.orders").columns == ["order_id", "customer_id", "order_amount", "order_date"]
    tables.ensure_tables(spark, database)
    assert spark.table(f"{database}.customers").count() == 5


def test_failed_load_changes_nothing(spark, golden, database):
    customers, lines = golden
    rollup = orders.order_rollup_sum(lines, customers)
    tables.load_all(customers, rollup, database, on_duplicate="keep")
    part = customers.filter("customer_id = 'K1'")
    with pytest.raises(tables.LoadError, match="customer_id"):
        tables.load_all(part, orders.order_rollup_sum(lines, part), database)
    with pytest.raises(tables.LoadError, match="not unique"):
        tables.load_all(customers.unionAll(customers), rollup, database)
    with pytest.raises(ValueError, match="order_amount"):
        tables.load_orders_full(rollup.drop("order_amount"), database)
    assert (spark.table(f"{database}.customers").count(), spark.table(f"{database}.orders").count()) == (5, 7)
    dropped = tables.load_orders_full(orders.order_rollup_sum(lines, part), database, on_null="drop")
    assert dropped == 3


def test_a_load_that_stops_between_two_steps_leaves_the_old_rows(spark, golden, database, monkeypatch):
    """Whether it stops after writing or at the switch, and a bad load after that."""
    customers, lines = golden
    rollup = orders.order_rollup_sum(lines, customers)
    tables.load_all(customers, rollup, database, on_duplicate="keep")
    for stop in ("switch", "staged"):
        with monkeypatch.context() as patch:
            def broken(*_, **__):
                raise RuntimeError("lost")

            patch.setattr(tables._Staged, "switch", broken) if stop == "switch" else patch.setattr(tables, "_Staged", broken)
            with pytest.raises(RuntimeError, match="lost"):
                tables.load_customers_full(customers.limit(1), database)
        assert spark.table(f"{database}.customers").count() == 5
        with pytest.raises(tables.LoadError):
            tables.load_customers_full(customers.unionAll(customers), database)
        tables.ensure_tables(spark, database)
        assert spark.table(f"{database}.customers").count() == 5
    assert tables.load_customers_full(customers.limit(2), database) == 2
    assert spark.table(f"{database}.customers").count() == 2


def test_a_failing_write_keeps_the_clean_dataset(spark, golden, tmp_path):
    customers, lines = golden
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        files.sink_orders_lines(lines, str(tmp_path / "lines"))
        bad = lines.withColumn("order_id", F.raise_error(F.lit("broken")).cast("string"))
        with pytest.raises(Exception, match="broken"):
            files.sink_orders_lines(bad, str(tmp_path / "lines"))
        assert scan_clean_lines(spark, str(tmp_path / "lines")).count() == len(LINES)
        for _ in range(3):
            files.sink_orders_lines(lines.filter("order_id = 'R12'"), str(tmp_path / "lines"))
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert {r.order_id for r in scan_clean_lines(spark, str(tmp_path / "lines")).collect()} == {"R12"}
    assert len(list((tmp_path / "lines").glob("version=*"))) == 2


# -- jobs ------------------------------------------------------------------------


def test_pipeline_from_raw_files(spark, tmp_path, database):
    extra = [("K9", "No Digits", "none", "Ridge")]
    put(tmp_path / "in", "2025-11-01", "customers.csv", customers_csv(CUSTOMERS + extra))
    put(tmp_path / "in", "2025-11-01", "orders.xml", orders_xml(LINES[:6]))
    put(tmp_path / "in", "2025-11-02", "orders.xml", orders_xml(LINES[4:] + [("R99", "n/k", "9999-12-31T00:00:00", "S", "1", "5")]))
    put(tmp_path / "in", "2025-11-03", "orders.xml", orders_xml()[:200])
    root, out = str(tmp_path / "in"), jobs.CleanPaths.under(str(tmp_path / "out"))
    result = jobs.run_pipeline(spark, root, root, out, database, AS_OF, on_duplicate="keep")
    assert tuple(result.clean.first()) == (["2025-11-01", "2025-11-02"], 6, 16, 5, 13, 1, 2, 1)
    assert [str(r.ingest_date) for r in result.skipped.collect()] == ["2025-11-03"]
    assert tuple(result.load.first()) == (5, 7)
    assert [c.value for c in result.kpis.first().cards] == ["5", "7", "1,571.00", "224.43", "50.0%"]
    assert {tuple(r) for r in result.report.collect()} == GOLDEN_REPORT
    again = jobs.run_pipeline(
        spark, root, root, out, database, AS_OF, on_duplicate="keep", grain="first", days=400, shared_number="once",
        cleaning=jobs.Cleaning(blank_mobile="keep"), intake=str(tmp_path / "intake"),
    )
    assert again.clean.first().cleaned_customers_rows == 6
    assert again.report.filter("kpi = 'top_spenders'").count() == 3
    with pytest.raises(BadFileError, match="2025-11-03"):
        jobs.merge_and_clean_batches(spark, root, root, out, jobs.Cleaning(on_bad_file="fail"))


def test_merge_of_new_files_equals_merge_of_all(spark, tmp_path):
    root = str(tmp_path / "in")
    out, full = (jobs.CleanPaths.under(str(tmp_path / name)) for name in ("out", "full"))
    put(tmp_path / "in", "2025-11-01", "customers.csv", customers_csv())
    for day, lines in (("2025-11-01", LINES[:6]), ("2025-11-02", LINES[4:])):
        put(tmp_path / "in", day, "orders.xml", orders_xml(lines))
        summary = jobs.merge_new_batches(spark, root, root, str(tmp_path / "intake"), out)
        want = jobs.merge_and_clean_batches(spark, root, root, full)
        assert tuple(summary.first()) == tuple(want.first())
        got, all_lines = (sorted(map(tuple, scan_clean_lines(spark, p.lines).collect())) for p in (out, full))
        assert got == all_lines


def test_merge_without_orders(spark, tmp_path):
    put(tmp_path / "in", "2025-11-01", "customers.csv", customers_csv())
    root = str(tmp_path / "in")
    out = jobs.CleanPaths.under(str(tmp_path / "out"))
    summary = jobs.merge_and_clean_batches(spark, root, root, out)
    assert tuple(summary.first()) == (["2025-11-01"], 5, 0, 5, 0, 0, 0, 0)
    assert not (tmp_path / "out" / "orders_clean_lines").exists()


def test_merge_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root = str(tmp_path / "in")
    summary = jobs.merge_and_clean_batches(spark, root, root, jobs.CleanPaths.under(str(tmp_path / "out")))
    assert tuple(summary.first()) == ([], 0, 0, 0, 0, 0, 0, 0)


def test_missing_input_fails_the_pipeline(spark, tmp_path, database):
    with pytest.raises(Exception, match="(?i)path"):
        jobs.run_pipeline(spark, str(tmp_path / "no"), str(tmp_path / "no"), jobs.CleanPaths.under(str(tmp_path / "out")), database, AS_OF)


def test_first_in_file_order_survives_cleaning(spark, tmp_path):
    """The later and smaller line of the same SKU does not win."""
    first = ("A", "911", "2025-10-02T00:00:00", "S", "1", "9")
    second = ("A", "911", "2025-10-01T00:00:00", "S", "1", "3")
    put(tmp_path / "in", "2025-11-01", "orders.xml", orders_xml([first]))
    put(tmp_path / "in", "2025-11-02", "orders.xml", orders_xml([second]))
    put(tmp_path / "in", "2025-11-01", "customers.csv", customers_csv([("C", "x", "1", "r"), ("C", "a", "+1", "r")]))
    root, out = str(tmp_path / "in"), jobs.CleanPaths.under(str(tmp_path / "out"))
    jobs.merge_and_clean_batches(spark, root, root, out)
    assert scan_clean_lines(spark, out.lines).first().total_amount == D("9.00")
    assert scan_clean_customers(spark, out.customers).first().customer_name == "X"


# -- both tables in one commit -------------------------------------------------------


def test_both_tables_change_in_one_step(spark, golden, database, monkeypatch):
    """Stopped at any call that writes or removes something, both tables are old or both are new."""
    customers, lines = golden
    rollup = orders.order_rollup_sum(lines, customers)
    part = customers.filter("customer_id = 'K1'")
    small = orders.order_rollup_sum(lines, part).filter("customer_id = 'K1'")
    sizes = {(5, 7), (1, 3)}
    tables.load_all(customers, rollup, database, on_duplicate="keep")
    seen = set()
    for name in ("new_version", "write_text", "expire_files", "expire_versions", "_switch", "_commit"):
        for nth in (1, 2):
            calls = []
            real = getattr(tables, name)

            def stopped(*args, calls=calls, nth=nth, real=real, **more):
                calls.append(1)
                if len(calls) == nth:
                    raise RuntimeError("lost")
                return real(*args, **more)

            before = (spark.table(f"{database}.customers").count(), spark.table(f"{database}.orders").count())
            assert before in sizes
            wanted = (part, small) if before == (5, 7) else (customers, rollup)
            with monkeypatch.context() as patch:
                patch.setattr(tables, name, stopped)
                try:
                    tables.load_all(*wanted, database, on_duplicate="keep")
                except RuntimeError:
                    pass
            now = (spark.table(f"{database}.customers").count(), spark.table(f"{database}.orders").count())
            assert now in sizes
            seen.add((before, now))
    assert len(seen) > 2
    assert tuple(tables.load_all(customers, rollup, database, on_duplicate="keep").first()) == (5, 7)


def test_first_load_keeps_the_rows_of_plain_tables_until_it_commits(spark, golden, database, monkeypatch):
    customers, lines = golden
    tables.ensure_tables(spark, database)
    customers.select("customer_id", "customer_name").write.insertInto(f"{database}.customers")
    rows = lambda: (spark.table(f"{database}.customers").count(), spark.table(f"{database}.orders").count())
    for name, nth in (("_create_view", 1), ("_create_view", 2), ("_switch", 1)):
        calls, real = [], getattr(tables, name)

        def stopped(*args, calls=calls, nth=nth, real=real):
            calls.append(1)
            if len(calls) == nth:
                raise RuntimeError("lost")
            return real(*args)

        with monkeypatch.context() as patch:
            patch.setattr(tables, name, stopped)
            with pytest.raises(RuntimeError):
                tables.load_all(customers.limit(1), orders.order_rollup_sum(lines, customers).limit(2), database)
        tables.ensure_tables(spark, database)
        assert rows() == (5, 0)
    tables.load_all(customers.limit(1), orders.order_rollup_sum(lines, customers).limit(2), database)
    assert rows() == (1, 2)


def test_views_read_one_version(spark, golden, database, plan):
    customers, lines = golden
    for _ in range(3):
        tables.load_all(customers, orders.order_rollup_sum(lines, customers), database, on_duplicate="keep")
    frame = spark.table(f"{database}.orders")
    assert "version" in plan(frame).split("PartitionFilters")[1].split("PushedFilters")[0]
    assert len(frame.inputFiles()) >= 1 and frame.count() == 7


# -- only what new files touch -------------------------------------------------------------


def _files(frame):
    """Version, month and name of the files of a dataset."""
    return {tuple(f.split("/")[-3:]) for f in frame.inputFiles()}


def _month_files(spark, path):
    return _files(scan_clean_lines(spark, path))


def _line(order, month, sku="S", number="911", amount="5"):
    return (order, number, f"2025-{month:02d}-10T00:00:00", sku, "1", amount)


def _daily(spark, tmp_path, name, **options):
    """Runs the job over the landed files incrementally, and in full beside it; both results."""
    got, want = (jobs.CleanPaths.under(str(tmp_path / n)) for n in (name, "full"))
    root = str(tmp_path / "in")
    summary = jobs.merge_new_batches(spark, root, root, str(tmp_path / "intake"), got, **options)
    full = jobs.merge_and_clean_batches(spark, root, root, want, **options)
    assert tuple(summary.first()) == tuple(full.first())
    results = [sorted(map(tuple, scan_clean_lines(spark, p.lines).collect()), key=str) for p in (got, want)]
    assert results[0] == results[1]
    return got


def test_a_late_file_rewrites_its_months_alone(spark, tmp_path):
    put(tmp_path / "in", "2025-11-01", "customers.csv", customers_csv())
    put(tmp_path / "in", "2025-11-01", "a.xml", orders_xml([_line("A", 1), _line("B", 2), _line("C", 3)]))
    out = _daily(spark, tmp_path, "out")
    first = _month_files(spark, out.lines)
    assert _daily(spark, tmp_path, "out") and _month_files(spark, out.lines) == first  # nothing is new
    # a late line of February: January and March keep their files
    put(tmp_path / "in", "2025-11-02", "b.xml", orders_xml([_line("D", 2)]))
    _daily(spark, tmp_path, "out")
    second = _month_files(spark, out.lines)
    assert len(first & second) == 2 and len(first) == 3 and len(second) >= 3
    recent = scan_recent_lines(spark, out.lines, datetime(2025, 3, 20))
    assert {r.order_id for r in recent.collect()} == {"C"} and len(recent.inputFiles()) < len(second)
    # a back-dated file whose line is the first of its key moves an order from one month to another
    put(tmp_path / "in", "2025-10-01", "c.xml", orders_xml([_line("A", 3), _line("A", 3, sku="T")]))
    _daily(spark, tmp_path, "out")
    third = _month_files(spark, out.lines)
    assert second & third and {r.order_id for r in scan_clean_lines(spark, out.lines).filter("month(order_date_time) = 1").collect()} == set()
    # a file that is replaced, and one that is removed
    put(tmp_path / "in", "2025-11-02", "b.xml", orders_xml([_line("D", 5), _line("E", 6)]))
    (tmp_path / "in" / "ingest_date=2025-10-01" / "c.xml").unlink()
    _daily(spark, tmp_path, "out")
    # other cleaning: everything again
    put(tmp_path / "in", "2025-11-03", "d.xml", orders_xml([_line("F", 1, number="none")]))
    _daily(spark, tmp_path, "out", cleaning=jobs.Cleaning(blank_mobile="keep"))
    assert {r.order_id for r in scan_clean_lines(spark, out.lines).collect()} == {"A", "B", "C", "D", "E", "F"}
    kept = {p.name for p in (tmp_path / "out" / "orders_clean_lines").glob("version=*")}
    assert 2 <= len(kept) <= 4


def test_a_merge_that_fails_leaves_the_lines(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "2025-11-01", "a.xml", orders_xml([_line("A", 1), _line("B", 2)]))
    out = _daily(spark, tmp_path, "out")
    put(tmp_path / "in", "2025-11-02", "b.xml", orders_xml([_line("D", 2)]))

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(files, "commit_months", broken)
        with pytest.raises(RuntimeError, match="lost"):
            jobs.merge_new_batches(spark, str(tmp_path / "in"), str(tmp_path / "in"), str(tmp_path / "intake"), out)
    assert {r.order_id for r in scan_clean_lines(spark, out.lines).collect()} == {"A", "B"}
    _daily(spark, tmp_path, "out")


def test_incremental_rollup_equals_the_full_one(spark, tmp_path, database):
    root, out = str(tmp_path / "in"), jobs.CleanPaths.under(str(tmp_path / "out"))

    def run():
        result = jobs.run_pipeline(spark, root, root, out, database, AS_OF, on_null="drop", on_duplicate="keep", intake=str(tmp_path / "intake"))
        got = scan_clean_rollup(spark, out.rollup)
        want = orders.order_rollup_sum(scan_clean_lines(spark, out.lines), scan_clean_customers(spark, out.customers))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)
        assert result.load.first().orders_loaded == got.na.drop().count()
        return _files(got)

    put(tmp_path / "in", "2025-11-01", "c.csv", customers_csv([("K1", "x", "911", "r"), ("K2", "y", "912", "r")]))
    put(tmp_path / "in", "2025-11-01", "a.xml", orders_xml([_line("A", 1), _line("B", 2, number="912"), _line("C", 3, number="913")]))
    first = run()
    assert run() == first
    put(tmp_path / "in", "2025-11-02", "b.xml", orders_xml([_line("D", 2)]))
    second = run()
    assert len(first & second) == 2
    # a customer for the number of an old order: its month alone
    put(tmp_path / "in", "2025-11-02", "c.csv", customers_csv([("K3", "z", "913", "r")]))
    third = run()
    assert len(second & third) == len(second) - 1
    # the lines moved on without the rollup: it is built anew
    put(tmp_path / "in", "2025-11-03", "d.xml", orders_xml([_line("A", 4, sku="T")]))
    jobs.merge_new_batches(spark, root, root, str(tmp_path / "intake"), out)
    assert not run() & third


def test_new_files_are_taken_a_page_at_a_time(spark, tmp_path, monkeypatch):
    from kpiloom.streaming import intake

    for k in range(5):
        put(tmp_path / "in", "2025-11-01", f"f{k}.xml", orders_xml([_line(f"O{k}", 1 + k)]))
    pages, real = [], intake.stage_pieces
    monkeypatch.setattr(intake, "stage_pieces", lambda pieces: pages.append(pieces.select("source_file").distinct().count()) or real(pieces))
    intake.stage_new_orders(spark, str(tmp_path / "in"), str(tmp_path / "staged"), max_files=2)
    assert pages == [2, 2, 1]
    rows = intake.read_staged_orders(spark, str(tmp_path / "in"), str(tmp_path / "staged")).rows
    assert sorted(r.order_id for r in rows.collect()) == [f"O{k}" for k in range(5)]
