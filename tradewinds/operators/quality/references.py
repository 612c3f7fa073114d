"""Referential checks. Child rows are counted per key before the keys meet, so skewed keys are harmless."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewinds.functions import percent, whole_minutes_between
from tradewinds.operators.aggregates import one_row_to_long
from tradewinds.operators.joins import count_by_key, lookup_join, match_counts
from tradewinds.operators.quality.keys import union_all


def orphan_values(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, skip_null: bool = True
) -> DataFrame:
    """(key, cnt): key values without a parent and the child rows behind them."""
    keys = count_by_key(child, child_key)
    # repeated parent keys collapse before they travel
    parents = parent.select(F.col(parent_key).alias("key")).distinct()
    lost = keys.join(parents, "key", "left_anti")
    return (lost.filter("key is not null") if skip_null else lost).select("key", F.col("rows").alias("cnt"))


def orphan_count(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, skip_null: bool = True
) -> DataFrame:
    """Child rows without a parent. NULL keys count only with ``skip_null=False``."""
    lost = orphan_values(child, child_key, parent, parent_key, skip_null)
    return lost.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("orphan_cnt"))


def referential_summary(rules: Mapping[str, tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """One row per rule: rule name -> (table name, child, child key, parent, parent key).

    All rules together are one aggregation. Every table is read once, whatever rules name it as child or parent: its keys
    are unfolded with the key column of a parent they belong to and the rule they are counted for, counted before the
    shuffle, and meet there.
    """
    spaces: dict[tuple[int, str], int] = {}
    tables: dict[int, tuple[DataFrame, list[Column]]] = {}

    def add(df: DataFrame, space: int, key: Column, rule: int) -> None:
        entry = F.struct(F.lit(space).alias("space"), key.cast("string").alias("key"), F.lit(rule).alias("rule"))
        tables.setdefault(id(df), (df, []))[1].append(entry)

    for number, (_, child, child_key, parent, parent_key) in enumerate(rules.values()):
        if (id(parent), parent_key) not in spaces:
            spaces[id(parent), parent_key] = len(spaces)
            add(parent, len(spaces) - 1, F.col(parent_key), -1)
        space = spaces[id(parent), parent_key]
        add(child, space, F.col(child_key).cast(parent.schema[parent_key].dataType), number)
    parts = [df.select(F.explode(F.array(*entries)).alias("e")).select("e.*") for df, entries in tables.values()]
    counts = [F.count_if(F.col("rule") == number).alias(f"n_{number}") for number in range(len(rules))]
    met = union_all(parts).filter("key is not null").groupBy("space", "key").agg(F.max(F.col("rule") == -1).alias("known"), *counts)
    rows = [
        {
            "table_name": F.lit(table),
            "rule_name": F.lit(rule),
            "orphan_cnt": F.coalesce(F.sum(F.when(~F.col("known"), F.col(f"n_{number}"))), F.lit(0)),
        }
        for number, (rule, (table, *_)) in enumerate(rules.items())
    ]
    return one_row_to_long(met, rows)


def orphan_drilldown(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, raw: DataFrame, raw_key: str | Column
) -> DataFrame:
    """Orphan key values, their rows, and whether the raw layer knows the key (0/1)."""
    lost = orphan_values(child, child_key, parent, parent_key)
    raw_key = F.col(raw_key) if isinstance(raw_key, str) else raw_key
    known = raw.select(raw_key.alias("key")).distinct().withColumn("found", F.lit(1))
    return lost.join(known, "key", "left").select("key", "cnt", F.coalesce("found", F.lit(0)).alias("exists_in_raw"))


def coverage_pct(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, skip_null: bool = True
) -> DataFrame:
    """Rows, unmatched rows, matched and unmatched percent of a lookup."""
    matches = match_counts(child, child_key, parent, parent_key)
    if skip_null:
        matches = matches.filter("key is not null")
    totals = matches.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_cnt"),
        F.coalesce(F.sum(F.when(F.col("matched") == 0, F.col("rows"))), F.lit(0)).alias("unmatched_cnt"),
    )
    rows, lost = F.col("row_cnt"), F.col("unmatched_cnt")
    return totals.select(
        "row_cnt",
        "unmatched_cnt",
        percent(rows - lost, rows).alias("coverage_pct"),
        percent(lost, rows).alias("unmatched_pct"),
    )


def early_events(child: DataFrame, child_ts: str, parent: DataFrame, parent_ts: str, key: str) -> DataFrame:
    """(key, child_ts, parent_ts): child events earlier than the event of their parent row."""
    events = child.select(key, F.col(child_ts).alias("child_ts"))
    base = parent.select(key, F.col(parent_ts).alias("parent_ts"))
    return lookup_join(events, base, key).filter(F.col("child_ts") < F.col("parent_ts"))


def cross_table_event_order(
    child: DataFrame, child_ts: str, parent: DataFrame, parent_ts: str, key: str
) -> DataFrame:
    """Early events: rows, distinct keys, smallest and largest gap in whole minutes (child - parent)."""
    early = early_events(child, child_ts, parent, parent_ts, key)
    gap = whole_minutes_between("parent_ts", "child_ts")
    per_key = early.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(gap).alias("low"), F.max(gap).alias("high"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("early_cnt"),
        F.count(F.lit(1)).alias("early_key_cnt"),
        F.min("low").alias("min_gap_min"),
        F.max("high").alias("max_gap_min"),
    )


def event_gap_histogram(child: DataFrame, child_ts: str, parent: DataFrame, parent_ts: str, key: str) -> DataFrame:
    """Early events per gap in whole minutes."""
    early = early_events(child, child_ts, parent, parent_ts, key)
    gap = whole_minutes_between("parent_ts", "child_ts").alias("gap_min")
    return early.groupBy(gap).agg(F.count(F.lit(1)).alias("cnt"))


def anomaly_attribution(anomalies: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Anomalous rows in keys that occur once and in keys that occur several times in ``df``."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    hits = anomalies.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(sizes, key, "left")
    repeated = F.coalesce(F.col("size") > 1, F.lit(False))
    return hits.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("anomaly_cnt"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("in_repeated_keys"),
        F.coalesce(F.sum(F.when(~repeated, F.col("n"))), F.lit(0)).alias("in_single_keys"),
    )
