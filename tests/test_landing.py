import os
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from golden import CUSTOMERS, LINES, customers_csv, orders_xml
from kpiloom.sources import landing, raw
from kpiloom.streaming.intake import read_staged_orders, stage_new_orders

HEADER = "customer_id,customer_name,mobile_number,region"


def put(root: Path, day: str, name: str, text: str) -> Path:
    folder = root / f"ingest_date={day}"
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return path


def customers_of(spark, root):
    rows, skipped = landing.read_customer_batches(spark, str(root))
    data = rows.orderBy(landing.INPUT_ORDER).drop(landing.INPUT_ORDER).collect()
    return [tuple(r) for r in data], sorted(str(r.ingest_date) for r in skipped.collect())


def orders_of(batches):
    rows, skipped = batches
    data = rows.orderBy(landing.INPUT_ORDER).select("order_id", "sku_id", "total_amount", "ingest_date").collect()
    return [tuple(r) for r in data], sorted(str(r.ingest_date) for r in skipped.collect())


# -- customers -----------------------------------------------------------------


def test_headers_are_aligned_by_name(spark, tmp_path):
    put(tmp_path, "2025-11-01", "customers.csv", f"{HEADER}\nC1,Ann,1,West\n")
    put(tmp_path, "2025-11-02", "customers.csv", "﻿customer_id,region,mobile_number,customer_name,age\nC2,East,2,Bob,7\n")
    put(tmp_path, "2025-11-03", "customers.csv", "customer_id,customer_name,mobile_number\nC3,Cy,3\n")
    put(tmp_path, "2025-11-04", "orders.xml", orders_xml())
    rows, skipped = customers_of(spark, tmp_path)
    assert rows == [
        ("C1", "Ann", "1", "West", date(2025, 11, 1)),
        ("C2", "Bob", "2", "East", date(2025, 11, 2)),
        ("C3", "Cy", "3", None, date(2025, 11, 3)),
    ]
    assert skipped == []


def test_quotes_spaces_and_missing_tokens(spark, tmp_path):
    text = f'{HEADER}\nC1," Ann ""A"", B ",007,NA\nC2,null,n/a,""\nC3,short\n'
    put(tmp_path, "2025-11-01", "customers.csv", text)
    rows, _ = customers_of(spark, tmp_path)
    assert [r[:4] for r in rows] == [
        ("C1", ' Ann "A", B ', "007", None),
        ("C2", None, None, None),
        ("C3", "short", None, None),
    ]


def test_file_with_an_overlong_row_is_skipped(spark, tmp_path):
    put(tmp_path, "2025-11-01", "customers.csv", f"{HEADER}\nC1,a,1,W\nC2,b,2,W,more\n")
    put(tmp_path, "2025-11-02", "customers.csv", f"{HEADER}\nC3,c,3,W\n")
    rows, skipped = customers_of(spark, tmp_path)
    assert [r[0] for r in rows] == ["C3"] and skipped == ["2025-11-01"]


def test_no_files_give_no_rows(spark, tmp_path):
    (tmp_path / "ingest_date=2025-11-01").mkdir()
    assert customers_of(spark, tmp_path) == ([], [])
    assert orders_of(landing.read_order_batches(spark, str(tmp_path))) == ([], [])


def test_plain_scan_refuses_a_reordered_header(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("customer_id,region,mobile_number,customer_name\nC,a,b,c\n")
    with pytest.raises(Exception, match="(?i)header"):
        raw.scan_customers_csv(spark, str(path)).collect()


def test_plain_scan_fails_on_a_malformed_file(spark, tmp_path):
    path = tmp_path / "o.xml"
    path.write_text(orders_xml(LINES[:3]))
    assert landing.scan_orders_xml(spark, str(path)).count() == 3
    path.write_text(orders_xml(LINES[:3])[:-60])
    with pytest.raises(landing.BadFileError, match="malformed"):
        landing.scan_orders_xml(spark, str(path))


# -- order lines -----------------------------------------------------------------


def both_readers(spark, root, tmp_path_factory):
    """The result of the batch read, checked to equal the incremental one."""
    batch = orders_of(landing.read_order_batches(spark, str(root)))
    work = tmp_path_factory.mktemp("intake")
    stage_new_orders(spark, str(root), str(work / "staged"))
    assert orders_of(read_staged_orders(spark, str(root), str(work / "staged"))) == batch
    return batch


def test_order_days(spark, tmp_path, tmp_path_factory):
    put(tmp_path, "2025-11-01", "orders.xml", orders_xml(LINES[:3]))
    put(tmp_path, "2025-11-02", "orders.xml", orders_xml(LINES[3:6], amount="order_amount"))
    put(tmp_path, "2025-11-03", "customers.csv", customers_csv())
    rows, skipped = both_readers(spark, tmp_path, tmp_path_factory)
    days = [date(2025, 11, 1)] * 3 + [date(2025, 11, 2)] * 3
    assert rows == [(l[0], l[3], l[5], d) for l, d in zip(LINES, days)]
    assert skipped == []


WHOLE = orders_xml(LINES[:3])
BROKEN = {
    "inside a tag": WHOLE[: WHOLE.rindex("<sku_id>") + 3],
    "between two fields": WHOLE[: WHOLE.rindex("<sku_count>")],
    "after an order": WHOLE[: WHOLE.rindex("</order>") + len("</order>")],
    "inside the root end": WHOLE[: WHOLE.rindex("</orders>") + 4],
    "mismatched tags": WHOLE.replace("</sku_id>", "</sku>", 1),
    "unclosed order": WHOLE.replace("</order>\n", "", 1),
    "not XML": "order_id,mobile\n1,2\n",
}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_file_is_skipped_whole(spark, tmp_path, tmp_path_factory, kind):
    put(tmp_path, "2025-11-01", "orders.xml", BROKEN[kind])
    put(tmp_path, "2025-11-02", "orders.xml", orders_xml(LINES[3:4]))
    rows, skipped = both_readers(spark, tmp_path, tmp_path_factory)
    assert [r[0] for r in rows] == [LINES[3][0]] and skipped == ["2025-11-01"]


def test_commented_out_orders_are_no_orders(spark, tmp_path, tmp_path_factory):
    """A comment over several records makes the file one that must not be cut."""
    lines = orders_xml(LINES[:5]).splitlines(keepends=True)
    starts = [i for i, l in enumerate(lines) if "<order>" in l and "<!--" not in l]
    ends = [i for i, l in enumerate(lines) if "</order>" in l]
    lines[starts[1]] = "<!-- out: " + lines[starts[1]]
    lines[ends[3]] = lines[ends[3]].rstrip("\n") + " -->\n"
    put(tmp_path, "2025-11-01", "orders.xml", "".join(lines))
    put(tmp_path, "2025-11-02", "orders.xml", orders_xml(LINES[5:6]))
    rows, skipped = both_readers(spark, tmp_path, tmp_path_factory)
    assert [r[:2] for r in rows] == [(l[0], l[3]) for l in (LINES[0], LINES[4], LINES[5])]
    assert skipped == []


def test_cdata_entities_and_attributes(spark, tmp_path, tmp_path_factory):
    one = orders_xml(LINES[:1]).replace("<order>\n", '<order kind="x">\n', 1).replace("SKU-0", "S&amp;U")
    two = orders_xml(LINES[1:2]).replace("SKU-1", "<![CDATA[a</order>b]]>")
    put(tmp_path, "2025-11-01", "orders.xml", one)
    put(tmp_path, "2025-11-02", "orders.xml", two)
    rows, skipped = both_readers(spark, tmp_path, tmp_path_factory)
    assert [r[1] for r in rows] == ["S&U", "a</order>b"] and skipped == []


def test_a_large_file_is_cut(spark, tmp_path):
    """One file becomes many tasks, with the same lines in the same order."""
    many = [(f"O{i:05d}", *LINES[0][1:]) for i in range(4000)]
    put(tmp_path, "2025-11-01", "orders.xml", orders_xml(many))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        pieces = landing.order_pieces(spark, str(tmp_path))
        assert pieces.select(F.spark_partition_id().alias("p")).distinct().count() > 5
        rows, skipped = orders_of(landing.read_order_batches(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r[0] for r in rows] == [m[0] for m in many] and skipped == []


def test_incremental_intake_reads_each_file_once(spark, tmp_path):
    root, staged = tmp_path / "in", str(tmp_path / "staged")
    (root / "ingest_date=2025-11-01").mkdir(parents=True)
    assert orders_of(read_staged_orders(spark, str(root), staged)) == ([], [])
    put(root, "2025-11-01", "orders.xml", orders_xml(LINES[:3]))
    stage_new_orders(spark, str(root), staged)
    put(root, "2025-11-02", "orders.xml", orders_xml(LINES[3:6]))
    stage_new_orders(spark, str(root), staged)
    stage_new_orders(spark, str(root), staged)
    rows, _ = orders_of(read_staged_orders(spark, str(root), staged))
    assert [r[:2] for r in rows] == [(l[0], l[3]) for l in LINES[:6]]
    assert len(list((tmp_path / "staged" / "lines").glob("batch=*"))) == 2


def test_land_batch_names_the_day_in_india(spark, tmp_path):
    frame = spark.createDataFrame(CUSTOMERS, "customer_id string, customer_name string, mobile_number string, region string")
    landing.land_batch(frame, str(tmp_path), "csv", datetime(2025, 11, 1, 19, 0))
    landing.land_batch(frame, str(tmp_path), "csv", datetime(2025, 11, 1, 18, 0))
    assert sorted(p.name for p in tmp_path.glob("ingest*")) == ["ingest_date=2025-11-01", "ingest_date=2025-11-02"]
    rows, _ = customers_of(spark, tmp_path)
    assert len(rows) == 2 * len(CUSTOMERS)


def test_late_old_and_replaced_files_are_read(spark, tmp_path):
    root, staged = tmp_path / "in", str(tmp_path / "staged")
    put(root, "2025-11-02", "orders.xml", orders_xml(LINES[3:4]))
    stage_new_orders(spark, str(root), staged)
    late = put(root, "2025-10-01", "orders.xml", orders_xml(LINES[:1]))
    os.utime(late, (1.6e9, 1.6e9))
    put(root, "2025-11-02", "orders.xml", orders_xml(LINES[4:6]))
    stage_new_orders(spark, str(root), staged, max_files=1)
    want = orders_of(landing.read_order_batches(spark, str(root)))
    assert orders_of(read_staged_orders(spark, str(root), staged)) == want
    assert [r[:2] for r in want[0]] == [(l[0], l[3]) for l in (LINES[0], *LINES[4:6])]
    late.unlink()
    assert len(orders_of(read_staged_orders(spark, str(root), staged))[0]) == 2


def test_closing_tag_with_a_space(spark, tmp_path, tmp_path_factory):
    put(tmp_path, "2025-11-01", "orders.xml", orders_xml(LINES[:4]).replace("</order>", "</order >"))
    put(tmp_path, "2025-11-02", "orders.xml", orders_xml(LINES[4:7]).replace("</order>", "</order\n>", 1))
    put(tmp_path, "2025-11-03", "orders.xml", orders_xml(LINES[:4]).replace("</order>", "</order >")[:-20])
    rows, skipped = both_readers(spark, tmp_path, tmp_path_factory)
    assert [r[:2] for r in rows] == [(l[0], l[3]) for l in LINES[:7]] and skipped == ["2025-11-03"]


def test_a_quoted_line_break_is_one_record(spark, tmp_path):
    text = f'{HEADER}\nC1,Ann,1,W\nC2,"Bo\n\nb, ""x""",222,"so\nuth"\nC3,Cy,3,E\n'
    put(tmp_path, "2025-11-01", "customers.csv", text)
    put(tmp_path, "2025-11-02", "customers.csv", '"customer_id",region,"mobile_number",x\nC4,N,4,\n')
    rows, skipped = customers_of(spark, tmp_path)
    assert [r[:4] for r in rows] == [
        ("C1", "Ann", "1", "W"), ("C2", 'Bo\n\nb, "x"', "222", "so\nuth"), ("C3", "Cy", "3", "E"), ("C4", None, "4", "N"),
    ]
    assert skipped == []


def test_a_comment_over_cuts_is_put_together_by_several_tasks(spark, tmp_path, plan):
    """A file with a comment over many records is read split by split."""
    many = [(f"O{i:05d}", *LINES[0][1:]) for i in range(3000)]
    text = orders_xml(many)
    a, b = text.index("<order>\n    <order_id>O00100"), text.index("</order>", text.index("O02500")) + len("</order>")
    put(tmp_path, "2025-11-01", "orders.xml", text[:a] + "<!-- " + text[a:b] + " -->" + text[b:])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        batches = landing.read_order_batches(spark, str(tmp_path))
        staged = landing.stage_pieces(landing.order_pieces(spark, str(tmp_path)))
        assert staged.select("split_start").distinct().count() > 5
        rows, skipped = orders_of(batches)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r[0] for r in rows] == [m[0] for m in many[:100] + many[2501:]] and skipped == []


def test_a_comment_that_never_ends_is_a_bad_file(spark, tmp_path, tmp_path_factory):
    put(tmp_path, "2025-11-02", "orders.xml", orders_xml(LINES[:4]).replace("</orders>", "<!-- </orders>"))
    assert "2025-11-02" in both_readers(spark, tmp_path, tmp_path_factory)[1]


def test_quoted_line_breaks_are_put_together_by_several_tasks(spark, tmp_path, monkeypatch):
    """A CSV file with values over line ends is worked on split by split."""
    rows = [(f"C{i:05d}", f'a "{i}"' if i % 7 else f"x\n{i},\ny", str(i), "W") for i in range(4000)]
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    put(tmp_path, "2025-11-01", "customers.csv", "\n".join([HEADER, *(",".join(map(quoted, r)) for r in rows)]) + "\n")
    put(tmp_path, "2025-11-02", "customers.csv", f"{HEADER}\nP,plain,1,W\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    grouped, real = [], landing._starts
    monkeypatch.setattr(landing, "_starts", lambda *args: grouped.append(real(*args)) or grouped[-1])
    try:
        got, skipped = customers_of(spark, tmp_path)
        assert grouped[0].select("split_start").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    windows = [w for w in grouped[0]._jdf.queryExecution().analyzed().toString().split("\n") if "windowspec" in w]
    assert all("split_start" in w for w in windows)
    assert [r[:4] for r in got] == [*rows, ("P", "plain", "1", "W")] and skipped == []


def test_plain_scan_reads_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "c.csv"
    for text, names in (
        (f'{HEADER}\nC1,Ann,1,W\nC2,"Bo\nb",222,south\n', ["Ann", "Bo\nb"]),
        (f'{HEADER}\nC2,Bo,222,"so\na,b,c,uth"\n', ["Bo"]),
        (f'{HEADER}\nC1,5" pipe,1,W\nC2,Cy,2,W\n', ['5" pipe', "Cy"]),
    ):
        path.write_text(text)
        assert [r.customer_name for r in raw.scan_customers_csv(spark, str(path)).collect()] == names


def test_batches_landed_at_the_same_time_lose_nothing(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame(CUSTOMERS, "customer_id string, customer_name string, mobile_number string, region string")
    moment, root = datetime(2025, 11, 1), str(tmp_path)
    real = landing.finish_landing
    # the second batch is landed whole while the first is written but not moved
    with monkeypatch.context() as patch:
        patch.setattr(landing, "finish_landing", lambda *_: (patch.undo(), landing.land_batch(frame, root, "csv", moment), real(spark, root)))
        landing.land_batch(frame, root, "csv", moment)
    assert len(customers_of(spark, tmp_path)[0]) == 2 * len(CUSTOMERS)
    # one that stops before it is moved is not seen, and is completed by the next
    with monkeypatch.context() as patch:
        patch.setattr(landing, "finish_landing", lambda *_: None)
        landing.land_batch(frame, root, "csv", moment)
    assert len(customers_of(spark, tmp_path)[0]) == 2 * len(CUSTOMERS)
    landing.land_batch(frame, root, "csv", moment)
    assert len(customers_of(spark, tmp_path)[0]) == 4 * len(CUSTOMERS)
    # one that fails while it is written leaves nothing
    with pytest.raises(Exception, match="broken"):
        landing.land_batch(frame.withColumn("region", F.raise_error(F.lit("broken")).cast("string")), root, "csv", moment)
    assert len(customers_of(spark, tmp_path)[0]) == 4 * len(CUSTOMERS)


def test_pieces_without_markup_are_spared_the_patterns(spark):
    """The patterns for comments and sections stand behind a byte search, and change no row."""
    values = ["\n<order><sku_id>a</sku_id>", "<order><sku_id><![CDATA[<order>]]></sku_id>", "<order a='1'>]]>", "<order><!-- <order> --><sku_id>b</sku_id>",
              "<order><sku_id>c</sku_id></order >\n<order><sku_id>d</sku_id>", "<order><order>", "\n</orders>\n", ""]
    rows = [(k, v, None, "f", 0) for k, v in enumerate(values)]
    pieces = spark.createDataFrame(rows, "row_number long, value string, ingest_date date, source_file string, split_start long")
    parsed = landing.stage_pieces(pieces)
    got = sorted((r.row_number, r.piece, r.sku_id, r.is_line, r.corrupt, r.unsplit, r.ends) for r in parsed.collect())
    assert got == [
        (0, 0, "a", True, False, False, False), (1, 0, "<order>", True, False, False, False), (2, 0, None, True, True, True, False),
        (3, 0, "b", True, False, False, False), (4, 0, "c", True, False, False, False), (4, 1, "d", True, False, False, False),
        (5, 0, None, True, True, False, False), (6, 0, None, False, False, False, True), (7, 0, None, False, False, False, False),
    ]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert all("CASE WHEN marked" in line or "marked" in line.partition("regexp_replace")[0] for line in plan.split("\n") if "regexp_replace" in line)


def test_plain_records_are_parsed_as_by_the_xml_parser(spark, monkeypatch):
    """One pattern takes plain records apart; every value is the parser's, and no plain record reaches it."""
    texts = ["a", "a  b", " a", "a\t", "", "  ", "null", "+91 0", "é", " x", "日本", "a>b", "&lt;", "a]b", "1.50", "$1\\2", "\x01", "x "]
    fields = ["order_id", "mobile_number", "order_date_time", "sku_id", "sku_count", "total_amount", "order_amount"]
    records = ["<order>" + "".join(f"<{name}>{text}</{name}>" for name in fields) for text in texts]
    records += ["\r\n <order>\n" + "\n".join(f"  <{name}>v{i}</{name}>" for i, name in enumerate(fields) if k >> i & 1) for k in range(0, 128, 3)]
    one, two = "<order_id>1</order_id>", "<sku_id>2</sku_id>"
    others = ["<batch>x y</batch>", "<batch></batch>", "<batch/>", "<a><b>1</b></a>", "<order_id>2</order_id>", "<SKU_ID>1</SKU_ID>", "text", "<a>1</b>", "<a b='1'>2</a>", "<!-- c -->"]
    records += [f"<order>{cut}" for other in others for cut in (other + one + two, one + other + two, one + two + other, two + other + one)]
    records += ['<?xml version="1.0"?>\n<orders>\n<order>' + one, "x<order>" + one, "--><order>" + one, "\x01<order>" + one, "<order>" + one + " ", "</orders>", "\x01", "<order>", None]
    pieces = spark.createDataFrame([(k, v, None, "f", 0) for k, v in enumerate(records)], "row_number long, value string, ingest_date date, source_file string, split_start long")

    def parsed():
        return sorted((r.row_number, r.piece, *r) for r in landing.stage_pieces(pieces).collect())

    got = parsed()
    plan = landing.stage_pieces(pieces)._jdf.queryExecution().optimizedPlan().toString()
    assert pieces.filter(F.col("value").rlike(landing._PLAIN)).count() > 50
    assert all("NOT plain" in line.partition("from_xml")[0] for line in plan.split("\n") if "from_xml" in line)
    monkeypatch.setattr(landing, "_PLAIN", "(?!)")
    assert parsed() == got


def test_xml_is_landed_compressed_and_its_text_is_not_staged(spark, tmp_path, tmp_path_factory):
    """Short compressed files, from which both readers get all rows; the parsed pieces do not hold the text again."""
    names = ["order_id", "mobile_number", "order_date_time", "sku_id", "sku_count", "total_amount"]
    rows = [(f"O{k:04d}", "<1&2>", None, "S", str(k), "1.50") for k in range(500)]
    frame = spark.createDataFrame(rows, ", ".join(f"{name} string" for name in names))
    landing.land_batch(frame, str(tmp_path), "xml", datetime(2025, 11, 1))
    put(tmp_path, "2025-11-02", "plain.xml", orders_xml(LINES[:1]))
    landed = [p for p in (tmp_path / "ingest_date=2025-11-01").iterdir() if not p.name.startswith(".")]
    assert landed and all(p.name.endswith(".xml.gz") for p in landed) and sum(p.stat().st_size for p in landed) < 500 * 30
    got, skipped = both_readers(spark, tmp_path, tmp_path_factory)
    assert sorted(r[0] for r in got) == sorted([r[0] for r in rows] + [LINES[0][0]]) and skipped == []
    whole = landing.read_order_batches(spark, str(tmp_path)).rows.filter("order_id = 'O0007'").select(*names).collect()
    assert [tuple(r) for r in whole] == [rows[7]]
    assert "body" not in landing.stage_pieces(landing.order_pieces(spark, str(tmp_path))).columns


def test_long_batches_are_landed_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(landing._XML_OPTIONS, "maxRecordsPerFile", "100")
    frame = spark.range(1000).selectExpr("cast(id as string) as order_id")
    landing.land_batch(frame, str(tmp_path), "xml", datetime(2025, 11, 1))
    assert len(list((tmp_path / "ingest_date=2025-11-01").glob("*.xml.gz"))) >= 10
    assert len(orders_of(landing.read_order_batches(spark, str(tmp_path)))[0]) == 1000


def test_records_as_writers_lay_them_out_are_taken_by_the_quick_pattern(spark, tmp_path, monkeypatch):
    """Nothing else takes what is landed, but for the first record of a file, and its values are the parser's."""
    names = ["order_id", "mobile_number", "order_date_time", "sku_id", "sku_count", "total_amount", "batch"]
    texts = ["a", "a  b", "+91 0", "é", "日本", "$1\\2", "a]b", None]
    rows = [tuple(texts[(k + i * (k // 8)) % 8] for i in range(7)) for k in range(64) if k != 7]
    landing.land_batch(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).coalesce(1), str(tmp_path), "xml", datetime(2025, 11, 1))
    landed = landing.order_pieces(spark, str(tmp_path))
    assert landed.filter(F.col("value").rlike(landing._LEAN)).count() == 62
    one, two = "<order_id>1</order_id>", "<sku_id>2</sku_id>"
    others = ["<batch>x y</batch>", "<batch></batch>", "<batch> x</batch>", "<a>x</a><b>y</b>", "<order_id>2</order_id>", "<SKU_ID>1</SKU_ID>", "text", "<a>1</b>", "<a b='1'>2</a>", "<a>&lt;</a>", " "]
    odd = [f"<order>{cut}" for other in others for cut in (other + one, one + other + two, one + two + other, two + one + other)]
    odd += [f"<order><order_id>{text}</order_id>" for text in (" a", "a ", "\ta", "a>b", "a&amp;b", "", "a\u00a0", "\x01")] + ["<order>", "<orders><order>" + one, "\x01<order>" + one]
    frame = spark.createDataFrame([(k, v, None, "f", 0) for k, v in enumerate(odd)], "row_number long, value string, ingest_date date, source_file string, split_start long")

    def parsed():
        return [sorted((r.source_file, r.row_number, r.piece, *map(str, r)) for r in landing.stage_pieces(pieces).collect()) for pieces in (landed, frame)]

    got = parsed()
    monkeypatch.setattr(landing, "_PLAIN", "(?!)")
    assert parsed() == got  # the full pattern is not what the values depend on
    monkeypatch.setattr(landing, "_LEAN", "(?!)")
    assert parsed() == got


def test_parsed_lines_are_written_small(spark, tmp_path):
    """The lines that the intake keeps and the parsed pieces are compressed by zstd."""
    root = str(tmp_path / "landing")
    landing.land_batch(spark.range(1000).selectExpr("concat('O', id) as order_id"), root, "xml", datetime(2025, 11, 1))
    stage_new_orders(spark, root, str(tmp_path / "intake"))
    rows = landing.read_order_batches(spark, root).rows
    pieces = [path for path in rows.inputFiles() if "/raw-orders-" in path]
    lines = [str(path) for path in (tmp_path / "intake" / "lines").rglob("*.parquet")]
    assert pieces and lines and all(path.endswith(".zstd.parquet") for path in pieces + lines)
    assert rows.count() == read_staged_orders(spark, root, str(tmp_path / "intake")).rows.count() == 1000
