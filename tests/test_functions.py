from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradewinds import functions as fx


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_clean_text(spark):
    values = [" Delivered\r", "", "  ", None, "A\rB "]
    assert column(spark, values, "string", fx.clean_text("x", case="lower")) == ["delivered", "", "", None, "ab"]
    assert column(spark, values, "string", fx.clean_text("x", case="upper", blank_to_null=True)) == [
        "DELIVERED",
        None,
        None,
        None,
        "AB",
    ]
    assert column(spark, ["a\r "], "string", fx.clean_text("x", drop_cr=False)) == ["a\r"]
    with pytest.raises(ValueError):
        fx.clean_text("x", case="title")


def test_blank_and_digits(spark):
    values = [None, "", " \r", "x", "12", "1a"]
    assert column(spark, values, "string", fx.is_blank("x")) == [True, True, False, False, False, False]
    assert column(spark, values, "string", fx.is_blank("x", cleaned=True)) == [True, True, True, False, False, False]
    assert column(spark, ["12", "1a"], "string", fx.is_digits("x")) == [True, False]
    assert column(spark, ["são"], "string", fx.text_bytes("x")) == [4]


def test_joined_label(spark):
    df = spark.createDataFrame([("a", "B"), ("a", None)], "c string, s string")
    assert [r[0] for r in df.select(fx.joined_label("c", "s")).collect()] == ["a_B", None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_ts_ignores_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    values = ["2017-03-12 02:30:00", "2017-1-2 3:4:5", "2017-01-02 03:04:05\r"]
    values += ["", None, "n/a", "2017-02-30 00:00:00", "2017-01-02", "2017-01-02T03:04:05", "2017-01-02 03:04:05.5"]
    try:
        got = column(spark, values, "string", fx.parse_ts("x"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    early = dt.datetime(2017, 1, 2, 3, 4, 5)
    assert got == [dt.datetime(2017, 3, 12, 2, 30), early, early] + [None] * 7


def test_unparseable(spark):
    values = ["n/a", "", None, "2017-01-02 03:04:05", " \r"]
    assert column(spark, values, "string", fx.is_unparseable_ts("x")) == [True, False, None, False, False] or column(
        spark, values, "string", F.coalesce(fx.is_unparseable_ts("x"), F.lit(False))
    ) == [True, False, False, False, False]


def test_lead_days(spark):
    t = dt.datetime
    rows = [
        (t(2017, 1, 1, 23, 50), t(2017, 1, 2, 0, 10)),
        (t(2017, 1, 1, 1), t(2017, 1, 1, 20)),
        (t(2017, 1, 2), t(2017, 1, 1)),
        (t(2017, 1, 2), None),
    ]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(fx.lead_days("a", "b")).collect()] == [1, 0, None, None]
    early = df.select(fx.lead_days("a", "b", not_before=F.lit(t(2016, 1, 1)).cast("timestamp_ntz")))
    assert [r[0] for r in early.collect()] == [1, 0, -1, None]


def test_month_arithmetic(spark):
    df = spark.createDataFrame([("2016-10", "2018-12"), ("2017-05", "2017-05"), ("2017-02", "2017-01")], "a string, b string")
    assert [r[0] for r in df.select(fx.month_offset("a", "b")).collect()] == [26, 0, -1]
    back = df.select(fx.month_label_of_index(fx.month_index("b"))).collect()
    assert [r[0] for r in back] == ["2018-12", "2017-05", "2017-01"]
    keys = spark.createDataFrame([(20170131,), (9991231,)], "k int").select(fx.month_label_of_key("k")).collect()
    assert [r[0] for r in keys] == ["2017-01", "0999-12"]


def test_whole_minutes_truncate_toward_zero(spark):
    a = dt.datetime(2017, 1, 1, 0, 1, 0)
    rows = [(a, a - dt.timedelta(seconds=30)), (a, a - dt.timedelta(seconds=61)), (a, a + dt.timedelta(seconds=119))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(fx.whole_minutes_between("a", "b")).collect()] == [0, -1, 1]


def test_calendar_attributes(spark):
    days = [dt.date(2016, 12, 31), dt.date(2017, 1, 1), dt.date(2017, 2, 28), dt.date(2016, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select(*fx.calendar_attributes("d"))
    rows = df.collect()
    assert [r["week_of_year"] for r in rows] == [52, 52, 9, 9]
    assert [r["day_of_week"] for r in rows] == [6, 7, 2, 1]
    assert [r["day_name"] for r in rows] == ["Saturday", "Sunday", "Tuesday", "Monday"]
    assert [r["is_weekend"] for r in rows] == [1, 1, 0, 0]
    assert [r["is_month_end"] for r in rows] == [1, 0, 1, 1]
    assert [r["is_month_start"] for r in rows] == [0, 1, 0, 0]
    assert rows[0]["date_key"] == 20161231 and rows[0]["year_quarter"] == "2016-Q4" and rows[0]["year_month"] == "2016-12"


def test_safe_ratio_and_percent(spark):
    df = spark.createDataFrame([(1, 640), (24, 324), (1, 0), (1, None), (0, 5)], "a int, b int")
    assert [r[0] for r in df.select(fx.safe_ratio(F.col("a"), F.col("b"))).collect()] == [
        Decimal("0.001563"),
        Decimal("0.074074"),
        None,
        None,
        Decimal("0.000000"),
    ]
    assert [r[0] for r in df.select(fx.percent(F.col("a"), F.col("b"))).collect()] == [
        Decimal("0.16"),
        Decimal("7.41"),
        None,
        None,
        Decimal("0.00"),
    ]
