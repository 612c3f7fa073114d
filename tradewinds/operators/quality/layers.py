"""Reconciliation between layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewinds.operators.aggregates import one_row_to_long
from tradewinds.operators.quality.keys import union_all

TOTAL_TYPE = "decimal(20,2)"
CHECKSUM_BUCKETS = 4096


def row_count_reconcile(pairs: Mapping[str, tuple[DataFrame, DataFrame | int]]) -> DataFrame:
    """entity -> (source, target): both row counts and target - source. A target may be the number of its rows.

    A one-column source counts as it is: pass its distinct keys to compare with a collapsed table.
    """
    parts = []
    for entity, (source, target) in pairs.items():
        rows = F.lit(target).cast("long") if isinstance(target, int) else target.agg(F.count(F.lit(1))).scalar()
        counts = source.agg(F.count(F.lit(1)).alias("source_cnt")).select(
            F.lit(entity).alias("entity"), "source_cnt", rows.alias("target_cnt")
        )
        parts.append(counts.withColumn("diff", F.col("target_cnt") - F.col("source_cnt")))
    return union_all(parts)


def _differs(pairs: Sequence[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a | b, [~a.eqNullSafe(b) for a, b in pairs])


def _checksums(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    """Per bucket of keys, sums over its rows that depend on every row and on no order."""
    row = F.xxhash64(*columns)
    low, high = row.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(row, 31).bitwiseAND(F.lit(0x7FFFFFFF))
    sums = F.struct(F.count(F.lit(1)).alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.bit_xor(row).alias("xor"))
    return df.groupBy("_bucket").agg(sums.alias(side))


def copy_mismatch(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows present in both whose columns differ (NULL equals NULL): total and per column.

    Both sides, tables with one row per key, are first summed up by bucket of keys, order-free and before any shuffle. Only
    rows of buckets whose sums differ are compared key by key, so equal tables are read and no row of them moves; two
    different buckets have equal sums with a chance of 2**-100 or so.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(CHECKSUM_BUCKETS)).alias("_bucket")
    a, b = left.select(key, *columns, bucket), right.select(key, *columns, bucket)
    sums = _checksums(a, [key, *columns], "a").join(_checksums(b, [key, *columns], "b"), "_bucket")
    # at most CHECKSUM_BUCKETS rows
    open_buckets = F.broadcast(sums.filter(F.col("a") != F.col("b")).select("_bucket"))
    a, b = a.join(open_buckets, "_bucket", "left_semi"), b.join(open_buckets, "_bucket", "left_semi")
    a = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    pairs = [(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in columns]
    return a.join(b, key).agg(
        F.count_if(_differs(pairs)).alias("mismatch_cnt"),
        *[F.count_if(_differs([p])).alias(f"{c}_diff_cnt") for c, p in zip(columns, pairs, strict=True)],
    )


def view_vs_source(
    view: DataFrame, source: DataFrame, keys: Sequence[str], measures: Sequence[str], missing_as: object | None = None
) -> DataFrame:
    """Rows of ``view`` whose measures differ from those of ``source`` (same names on both sides).

    Without ``missing_as`` only common keys are compared; with it every view row is, and a
    measure absent from the source counts as that value.
    """
    s = source.select(*keys, *[F.col(m).alias(f"{m}_source") for m in measures])
    joined = view.select(*keys, *measures).join(s, list(keys), "inner" if missing_as is None else "left")
    if missing_as is not None:
        joined = joined.withColumns({f"{m}_source": F.coalesce(f"{m}_source", F.lit(missing_as)) for m in measures})
    differs = reduce(lambda a, b: a | b, [F.col(m) != F.col(f"{m}_source") for m in measures])
    gaps = [(F.col(m) - F.col(f"{m}_source")).alias(f"{m}_diff") for m in measures]
    return joined.filter(differs).select("*", *gaps)


def grand_total_reconcile(
    totals: Mapping[str, tuple[tuple[DataFrame, Column], tuple[DataFrame, Column]]],
) -> DataFrame:
    """measure -> ((frame, aggregate), (frame, aggregate)): both totals and their difference.

    A frame that occurs in several measures is aggregated once.
    """
    frames: dict[int, tuple[DataFrame, list[tuple[str, str, Column]]]] = {}
    for name, sides in totals.items():
        for side, (frame, total) in zip(("left_total", "right_total"), sides, strict=True):
            frames.setdefault(id(frame), (frame, []))[1].append((name, side, total))
    long = union_all(
        [
            one_row_to_long(
                frame,
                [{"measure": F.lit(m), "side": F.lit(side), "total": total.cast(TOTAL_TYPE)} for m, side, total in wanted],
            )
            for frame, wanted in frames.values()
        ]
    )
    sides = [F.max(F.when(F.col("side") == side, F.col("total"))).alias(side) for side in ("left_total", "right_total")]
    diff = (F.col("left_total") - F.col("right_total")).cast(TOTAL_TYPE).alias("diff")
    return long.groupBy("measure").agg(*sides).select("measure", "left_total", "right_total", diff)
