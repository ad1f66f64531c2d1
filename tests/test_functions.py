import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kpiloom import functions as fn


def test_title_case(values):
    texts = ["o'brien mary-jane", "3rd st", "élan d'or", None, "", "McDONALD", "ßtraße", "中a b", "ΟΔΟΣ"]
    assert values(fn.title_case, texts) == [t if t is None else t.title() for t in texts]


def test_title_case_agrees_with_python(values):
    """Random texts over Latin, Greek, Cyrillic, Arabic, CJK, digits and signs."""
    pick = random.Random(7)
    letters = [chr(c) for c in (*range(0x20, 0x250), *range(0x370, 0x52F), *range(0x620, 0x64A), *range(0x4E00, 0x4E20))]
    # One letter got an upper case only in a later Unicode version than Python's.
    letters = [c for c in letters if c.isprintable() and c != "\u019b"] + [" ", "'", "-", "1"] * 60
    texts = ["".join(pick.choices(letters, k=pick.randint(0, 40))) for _ in range(2000)]
    got = values(fn.title_case, texts)
    assert [(t, g) for t, g in zip(texts, got) if g != t.title()] == []


def test_trim_text(values):
    texts = ["\t ann \n", "　a b ", "\x1cx\x85", "", None]
    assert values(fn.trim_text, texts) == ["ann", "a b", "x", "", None]


def test_digits_only(values):
    texts = ["+91 98-76", "n/a", "0912", "+91 98-76 ٣", None]
    assert values(fn.digits_only, texts) == ["919876", "", "0912", "919876٣", None]


def test_null_if_missing(values):
    assert values(fn.null_if_missing, ["NA", "n/a", "", "x", None, "Nan"]) == [None, None, None, "x", None, "Nan"]


def test_safe_amount(values):
    texts = ["74.5", " 12 ", "1e3", "1,000", "1.0d", "x", None]
    want = [Decimal(t) for t in ("74.50", "12.00", "1000.00", "0.00", "0.00", "0.00", "0.00")]
    assert values(fn.safe_amount, texts) == want


def test_safe_timestamp(values):
    texts = ["2025-10-12T09:15:32", "2025-10-12", "bad", None]
    want = [datetime(2025, 10, 12, 9, 15, 32), datetime(2025, 10, 12), None, None]
    assert values(fn.safe_timestamp, texts) == want


def test_parse_iso_date(values):
    texts = ["2025-10-12T09:15:32", "2025-10-12", "bad"]
    assert values(fn.parse_iso_date, texts) == [date(2025, 10, 12), date(2025, 10, 12), None]


def test_format_pct(values):
    assert values(fn.format_pct, [0.25, 50.0, 66.666, 0.35], "v double") == ["0.2%", "50.0%", "66.7%", "0.3%"]


def test_format_money(values):
    assert values(fn.format_money, [73967.0, 0.125, 0.0], "v double") == ["73,967.00", "0.12", "0.00"]


def test_calendar(values):
    moments = [datetime(2025, 11, 1, 19, 0), datetime(2025, 11, 1, 18, 0)]
    schema = "v timestamp_ntz"
    assert values(fn.partition_date_ist, moments, schema) == [date(2025, 11, 2), date(2025, 11, 1)]
    assert values(fn.year_month, moments, schema) == ["2025-11", "2025-11"]
    assert values(fn.day_of, moments, schema) == [date(2025, 11, 1)] * 2


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kolkata"])
def test_calendar_ignores_the_session_zone(spark, values, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        moments = [datetime(2018, 11, 4, 0, 30), datetime(2025, 11, 1, 19, 0)]
        schema = "v timestamp_ntz"
        assert values(fn.partition_date_ist, moments, schema) == [date(2018, 11, 4), date(2025, 11, 2)]
        assert values(fn.year_month, moments, schema) == ["2018-11", "2025-11"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_safe_ratio_and_zero_if_null(spark):
    row = spark.range(1).select(
        fn.safe_ratio(F.lit(1), F.lit(4)).alias("a"),
        fn.safe_ratio(F.lit(1), F.lit(0)).alias("b"),
        fn.safe_ratio(F.lit(None).cast("int"), F.lit(2)).alias("c"),
        fn.zero_if_null(F.lit(None).cast("int")).alias("d"),
    ).first()
    assert tuple(row) == (0.25, 0.0, 0.0, 0)


def test_a_number_too_large_is_an_error_not_zero(spark):
    big = spark.createDataFrame([("99999999999999999",)], "t string")
    with pytest.raises(Exception, match="amount out of range"):
        big.select(fn.safe_amount(F.col("t"))).collect()


def test_moments_outside_the_range_do_not_parse(values):
    texts = ["9999-12-31", "200000-01-01", "1600-01-01", "2262-04-11T23:00:00"]
    assert values(fn.safe_timestamp, texts) == [None, None, None, datetime(2262, 4, 11, 23)]
