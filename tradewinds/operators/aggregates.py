"""Aggregation operators: most frequent value per key, conditional distinct counts, month pivots, long reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCENT_FREE = "UNICODE_CI_AI"


def mode_by_key(
    df: DataFrame,
    key: str,
    value_cols: Sequence[str],
    count_name: str = "cnt",
    collation: str | None = None,
) -> DataFrame:
    """Most frequent combination of ``value_cols`` per key; ties go to the smallest values (NULL first).

    Two partial aggregations: rows collapse to one per (key, values) and then to one per
    key, so a heavy key is never gathered or sorted in one task. ``collation`` groups text
    values that are equal under that collation and reports the smallest spelling.
    """
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    if collation is None:
        counted = df.groupBy(key, *value_cols).agg(F.count(F.lit(1)).alias("n"))
    else:
        groups = [F.collate(c, collation).alias(f"_{c}") if c in text else F.col(c).alias(f"_{c}") for c in value_cols]
        counted = df.groupBy(key, *groups).agg(
            F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in value_cols]
        )
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), *value_cols)).alias("best"))
    return best.select(key, *[F.col(f"best.{c}").alias(c) for c in value_cols], (-F.col("best.n")).alias(count_name))


def conditional_distinct(
    df: DataFrame, group: Sequence[str], key: str, conditions: Mapping[str, Column | None]
) -> DataFrame:
    """Per group: distinct ``key`` values among the rows meeting each condition (None = all rows).

    Rows first collapse to (group, key) with one flag per condition, then flags are summed.
    Several conditions therefore cost one shuffle of keys, not one copy of the rows each.
    """
    per_key = df.filter(F.col(key).isNotNull()).groupBy(*group, key).agg(
        *[
            F.max(F.when(F.lit(True) if cond is None else cond, 1).otherwise(0)).alias(name)
            for name, cond in conditions.items()
        ]
    )
    return per_key.groupBy(*group).agg(*[F.sum(name).alias(name) for name in conditions])


def pivot_months(
    df: DataFrame,
    group: str,
    value: str,
    suffix: str,
    months: int = 12,
    carry: Sequence[Column] = (),
    fill: object | None = None,
    how: str = "sum",
) -> DataFrame:
    """One row per ``group`` with columns m0_suffix .. m<months>_suffix taken from ``month_n``.

    The pivot values are given, so no extra job looks for them. ``fill`` replaces missing months.
    """
    reduce = {"sum": F.sum, "max": F.max}[how]
    kind = df.schema[value].dataType

    def cell(n: int) -> Column:
        out = reduce(F.when(F.col("month_n") == n, F.col(value)))
        out = out if fill is None else F.coalesce(out, F.lit(fill))
        return out.cast(kind).alias(f"m{n}_{suffix}")

    return df.groupBy(group).agg(*carry, *[cell(n) for n in range(months + 1)])


def one_row_to_long(
    df: DataFrame, rows: Sequence[Mapping[str, Column]], lead: Mapping[str, Column] | None = None
) -> DataFrame:
    """Turn aggregates of the whole frame into several report rows with a single pass.

    ``rows`` holds one mapping per report row; every value is an aggregate or a literal and
    all mappings share their column names.
    """
    lead = lead or {}
    structs = [F.struct(*[c.alias(n) for n, c in {**lead, **row}.items()]) for row in rows]
    names = [*lead, *rows[0]]
    return df.agg(F.array(*structs).alias("rows")).select(F.explode("rows").alias("r")).select(
        *[F.col(f"r.{n}").alias(n) for n in names]
    )
