"""Calendar spine: date bounds, day series, month spine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.functions import calendar_attributes, month_index, month_label_of_index


def date_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (start_date, end_date): a month before the earliest and after the latest of all the columns.

    One pass; NULLs are skipped. Month arithmetic clamps to the length of the month.
    """
    earliest = [F.min(F.col(c).cast("date")) for c in columns]
    latest = [F.max(F.col(c).cast("date")) for c in columns]
    low = earliest[0] if len(columns) == 1 else F.least(*earliest)
    high = latest[0] if len(columns) == 1 else F.greatest(*latest)
    return df.agg(low.alias("low"), high.alias("high")).select(
        F.add_months("low", -1).alias("start_date"), F.add_months("high", 1).alias("end_date")
    )


def generate_calendar(bounds: DataFrame) -> DataFrame:
    """One row ``d`` per day between start_date and end_date, both included, however many there are."""
    return bounds.filter("start_date is not null and end_date is not null").select(
        F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("d")
    )


def calendar_table(days: DataFrame) -> DataFrame:
    return days.select(*calendar_attributes("d"))


def dense_months(dim_date: DataFrame) -> DataFrame:
    """Every month label of the calendar, once. Bounded by twelve rows a year."""
    return dim_date.select("year_month").distinct()


def fill_months(
    df: DataFrame, group: str, cohort: str, last_month: Column, measures: Mapping[str, Column], active: str | None = None
) -> DataFrame:
    """Add the silent months of each group, from its first row to ``last_month``, with the given empty measures.

    Each row also stands for the months up to the next row of its group, so the grid needs no
    join: one window over a group's months and one explode. ``month_n`` counts from ``cohort``;
    ``active`` names an optional 0/1 column telling real rows from added ones.
    """
    here = month_index("year_month")
    following = F.lead(here).over(W.partitionBy(group).orderBy("year_month"))
    stop = F.coalesce(following - 1, F.greatest(here, month_index(last_month)))
    rows = df.select("*", here.alias("_here"), stop.alias("_stop")).select(
        "*", F.explode(F.sequence("_here", "_stop")).alias("_m")
    )
    real = F.col("_m") == F.col("_here")
    return rows.select(
        *dict.fromkeys([group, cohort]),
        month_label_of_index("_m").alias("year_month"),
        (F.col("_m") - month_index(cohort)).alias("month_n"),
        *[F.when(real, F.col(name)).otherwise(empty).alias(name) for name, empty in measures.items()],
        *([] if active is None else [F.when(real, 1).otherwise(0).alias(active)]),
    )
