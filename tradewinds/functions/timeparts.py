"""Time parsing and calendar arithmetic on zone-free timestamps and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewinds.functions.ratios import to_flag
from tradewinds.functions.text import clean_text, is_blank

TS_SHAPE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c: Column | str) -> Column:
    """'yyyy-MM-dd HH:mm:ss' text -> TIMESTAMP_NTZ; blank or malformed text -> NULL.

    The cast goes straight to the zone-free type, so the session time zone (and its
    daylight-saving gaps) cannot move a value, and the try-form keeps ANSI mode quiet.
    """
    text = clean_text(c)
    return F.when(text.rlike(TS_SHAPE), text.try_cast("timestamp_ntz"))


def is_unparseable_ts(c: Column | str) -> Column:
    """TRUE for text that is present but is not a timestamp."""
    return ~is_blank(c, cleaned=True) & parse_ts(c).isNull()


def month_label(c: Column | str) -> Column:
    """'YYYY-MM' of a date or timestamp; text order equals time order."""
    return F.substring(_col(c).cast("date").cast("string"), 1, 7)


def month_index(label: Column | str) -> Column:
    """Months since year 0 of a 'YYYY-MM' label."""
    text = _col(label)
    return F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int")


def month_label_of_index(index: Column | str) -> Column:
    zero_based = _col(index) - 1
    year = F.floor(zero_based / 12).cast("int")
    month = F.pmod(zero_based, F.lit(12)) + 1
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"))


def month_offset(start: Column | str, end: Column | str) -> Column:
    """Whole months from one 'YYYY-MM' label to another."""
    return month_index(end) - month_index(start)


def date_key(c: Column | str) -> Column:
    """YYYYMMDD as an integer."""
    d = _col(c)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def month_label_of_key(key: Column | str) -> Column:
    """'YYYY-MM' of a YYYYMMDD key."""
    digits = F.lpad(_col(key).cast("string"), 8, "0")
    return F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2))


def lead_days(start: Column | str, end: Column | str, not_before: Column | str | None = None) -> Column:
    """Calendar days from ``start`` to ``end``; NULL when missing or when ``end`` precedes ``not_before``.

    ``not_before`` defaults to ``start``. The comparison uses the full timestamps, the
    difference only the dates (23:50 to 00:10 is one day).
    """
    start, end = _col(start), _col(end)
    guard = start if not_before is None else _col(not_before)
    return F.when(end >= guard, F.datediff(end, start))


def whole_minutes_between(start: Column | str, end: Column | str) -> Column:
    """Complete minutes, truncated toward zero (-30 seconds is 0 minutes)."""
    return F.timestamp_diff("MINUTE", _col(start), _col(end))


def calendar_parts(ts: Column | str, prefix: str = "order_") -> list[Column]:
    """Date, year, month number and month label of a timestamp."""
    ts = _col(ts)
    return [
        F.year(ts).alias(f"{prefix}year"),
        F.month(ts).alias(f"{prefix}month"),
        month_label(ts).alias(f"{prefix}year_month"),
    ]


def calendar_attributes(d: Column | str) -> list[Column]:
    """The 14 columns of the calendar dimension for a DATE column (ISO weeks, Monday = 1)."""
    d = _col(d)
    day_of_week = F.weekday(d) + 1
    return [
        date_key(d).alias("date_key"),
        d.alias("date"),
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        month_label(d).alias("year_month"),
        F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias("year_quarter"),
        F.weekofyear(d).alias("week_of_year"),
        day_of_week.alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        to_flag(day_of_week >= 6).alias("is_weekend"),
        to_flag(F.dayofmonth(d) == 1).alias("is_month_start"),
        to_flag(d == F.last_day(d)).alias("is_month_end"),
    ]
