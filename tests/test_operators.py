from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from tradewinds.operators import joins
from tradewinds.operators.aggregates import conditional_distinct, mode_by_key, pivot_months
from tradewinds.operators.calendar import date_bounds, fill_months, generate_calendar


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def skewed(spark):
    """A third of the rows on one key, some copies, some NULL and some unknown keys."""
    left = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("k"), (F.col("id") % 500).cast("string")))
        .when(F.col("id") % 7 == 0, None)
        .otherwise("unknown")
        .alias("key"),
        (F.col("id") % 50).alias("v"),
    )
    right = spark.range(500).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"),
        F.col("id").alias("w"),
    )
    return left, right


def test_lookup_join_paths_agree(spark, large_sides):
    left, right = skewed(spark)
    heavy = dict(joins.heavy_keys(left, "key"))
    assert heavy["hot"] > 100 and heavy[None] > 10
    for how in ("inner", "left"):
        salted = joins.lookup_join(left, right, "key", how, list(heavy.items()))
        assert rows(salted) == rows(joins.lookup_join(left, right, "key", how))
        assert rows(salted) == rows(left.join(right, "key", how))
        plan = salted._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_salts_spread_the_heavy_key(spark, large_sides):
    left = spark.range(30000).select(F.lit("hot").alias("key"), F.col("id").alias("v"))
    right = spark.createDataFrame([("hot", 1)], "key string, w int")
    joined = joins.lookup_join(left, right, "key", heavy=joins.heavy_keys(left, "key"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) == 8 and max(r["count"] for r in per_task) < 30000 / 2


def test_lookup_join_without_heavy_keys_is_a_plain_join(spark, large_sides):
    left = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    right = left.withColumn("w", F.lit(1))
    joined = joins.lookup_join(left, right, "key")
    assert joined.columns == ["key", "w"] and joined.count() == 5000
    assert "_salt" not in joined._jdf.queryExecution().analyzed().toString()


def test_small_side_is_broadcast_only_when_its_inputs_are_small(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.col("id").cast("string").alias("key")).write.parquet(path)
    small = spark.read.parquet(path)
    assert 0 < joins.input_bytes(small) < 100_000
    assert joins.is_small(small)
    spark.conf.set(joins.BROADCAST_LIMIT_CONF, "10")
    try:
        assert not joins.is_small(small)
    finally:
        spark.conf.unset(joins.BROADCAST_LIMIT_CONF)
    # inputs add up over the whole plan
    assert joins.input_bytes(small.join(small.groupBy("key").count(), "key")) == 2 * joins.input_bytes(small)


def test_mode_by_key_ties_and_nulls(spark):
    data = [("z", 2, 1), ("z", 1, 9), ("z", 1, 3), ("y", None, 5), ("y", 4, 5), ("x", 7, 7), ("x", 7, 7), ("x", 1, 1)]
    df = spark.createDataFrame(data, "k string, a int, b int")
    assert rows(mode_by_key(df, "k", ["a", "b"])) == Counter({("z", 1, 3, 1): 1, ("y", None, 5, 1): 1, ("x", 7, 7, 2): 1})


def test_mode_by_key_collation(spark):
    data = [("z", "são paulo"), ("z", "sao paulo"), ("z", "SAO PAULO"), ("z", "rio"), ("z", "rio")]
    df = spark.createDataFrame(data, "k string, city string")
    assert rows(mode_by_key(df, "k", ["city"])) == Counter({("z", "rio", 2): 1})
    assert rows(mode_by_key(df, "k", ["city"], collation="UNICODE_CI_AI")) == Counter({("z", "SAO PAULO", 3): 1})


def test_conditional_distinct(spark):
    data = [("g", "a", 1), ("g", "a", 0), ("g", "b", 0), ("g", None, 1), ("h", "c", 0)]
    df = spark.createDataFrame(data, "g string, k string, f int")
    got = conditional_distinct(df, ["g"], "k", {"everything": None, "flagged": F.col("f") == 1})
    assert rows(got) == Counter({("g", 2, 1): 1, ("h", 1, 0): 1})


def test_pivot_months(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 2, 7), ("d", 0, 1)], "c string, month_n int, v bigint")
    assert rows(pivot_months(df, "c", "v", "x", 2)) == Counter({("c", 5, None, 7): 1, ("d", 1, None, None): 1})
    assert rows(pivot_months(df, "c", "v", "x", 2, fill=0)) == Counter({("c", 5, 0, 7): 1, ("d", 1, 0, 0): 1})


def test_date_bounds_clamp_and_skip_nulls(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2017, 3, 31), None), (d(2017, 5, 1), d(2018, 1, 31))], "a date, b date")
    bounds = date_bounds(df, ["a", "b"])
    assert tuple(bounds.first()) == (d(2017, 2, 28), d(2018, 2, 28))
    assert generate_calendar(bounds).count() == 366
    empty = date_bounds(df.filter("a is null"), ["a"])
    assert generate_calendar(empty).count() == 0


def test_fill_months(spark):
    df = spark.createDataFrame(
        [("p", "2016-11", "2016-11", Decimal("1.50")), ("p", "2016-11", "2017-02", Decimal("2.00"))],
        "p string, c string, year_month string, v decimal(18,2)",
    )
    got = fill_months(df, "p", "c", F.lit("2017-03"), {"v": F.lit(0).cast("decimal(18,2)")}, active="on")
    table = [tuple(r) for r in got.orderBy("year_month").select("year_month", "month_n", "v", "on").collect()]
    zero = Decimal("0.00")
    assert table == [
        ("2016-11", 0, Decimal("1.50"), 1),
        ("2016-12", 1, zero, 0),
        ("2017-01", 2, zero, 0),
        ("2017-02", 3, Decimal("2.00"), 1),
        ("2017-03", 4, zero, 0),
    ]
