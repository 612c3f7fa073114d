"""Key lookups that stay safe when one key owns a large share of the rows.

``lookup_join`` starts no job. It has two forms, chosen while the plan is built:

* the looked-up side is small in memory (``is_small``): it is broadcast and the big side is not shuffled at all;
* otherwise both sides are shuffled on the key, and adaptive execution splits the partitions of heavy keys.

Where heavy keys are known beforehand, for example from ``heavy_keys`` over a stored table, they can be passed in and
are salted: their rows are spread by a hash of the whole row and the looked-up row is repeated once per salt. The
list is a fixed part of the plan - both sides and every retried task see the same salts.

``count_by_key`` + ``match_counts`` serve the checks that only need totals: rows are
counted per key before the shuffle, so a heavy key travels as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# input files to a partition of ``dealt``; tables smaller than DEALT_FROM in all are left to adaptive execution
DEALT_BYTES, DEALT_FROM, MOST_PARTITIONS = 4 << 20, 32 << 20, 1 << 13
UNKNOWN_BYTES = 1 << 60
BROADCAST_LIMIT_CONF = "spark.tradewinds.broadcastInputBytes"
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
# rows in memory take several times the bytes of compressed column files
BYTES_IN_MEMORY_PER_FILE_BYTE = 4
MAX_HEAVY_KEYS = 1000
SKETCH_ITEMS = 20000
HEAVY_SHARE = 0.001


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of all inputs below ``df`` (file sizes), None when unknown.

    For frames built by filters, projections, aggregations and key lookups this bounds the
    rows of the result; join estimates of the optimizer multiply sizes and are of no use.
    Only the analyzed plan is looked at, so nothing is optimized or run for the answer.
    """
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # noqa: BLE001 - no JVM access (for example a remote session): size unknown
        return None


def broadcast_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BROADCAST_LIMIT_CONF, str(DEFAULT_BROADCAST_LIMIT)))


def is_small(df: DataFrame) -> bool:
    """Whether the inputs of ``df`` take at most the limit in memory, as estimated from the size of their files."""
    size = input_bytes(df)
    return size is not None and size * BYTES_IN_MEMORY_PER_FILE_BYTE <= broadcast_limit(df)


def dealt(df: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """Deal the rows by ``keys`` to partitions whose number follows the bytes of the input.

    Adaptive execution merges shuffle partitions up to a size in compressed bytes, or to one for each core, so what a task
    sorts and groups grows with the input until then. Partitions asked for by number are not merged, and the other side
    of a join on the keys follows them. Meant for rows that are grouped by the keys afterwards, where heavy keys can't
    be split anyway. ``each``: bytes of the input to a partition.
    """
    size = input_bytes(df)
    if size is None or not DEALT_FROM <= size < UNKNOWN_BYTES:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, min(MOST_PARTITIONS, ceil(size / (each or DEALT_BYTES)))), *keys)


def heavy_keys(df: DataFrame, key: str) -> list[tuple[object, int]]:
    """(key, salts) for the at most MAX_HEAVY_KEYS keys above HEAVY_SHARE of the rows, NULL included.

    A key gets one salt per HEAVY_SHARE of the rows it holds. Runs one job over the key column;
    what comes back to the driver is bounded by the sketch.
    """
    return heavy_keys_of(df, [key])[key]


def heavy_keys_of(df: DataFrame, keys: Sequence[str]) -> dict[str, list[tuple[object, int]]]:
    """As ``heavy_keys``, for several columns in one job."""
    asked = {}
    for key in keys:
        asked[f"top_{key}"] = F.expr(f"approx_top_k(`{key}`, {MAX_HEAVY_KEYS}, {SKETCH_ITEMS})")
        asked[f"nulls_{key}"] = F.count_if(F.col(key).isNull())
    found = df.agg(F.count(F.lit(1)).alias("total"), *[c.alias(name) for name, c in asked.items()]).first()
    fair = max(found["total"] * HEAVY_SHARE, 1)
    out = {}
    for key in keys:
        counts = {t["item"]: t["count"] for t in found[f"top_{key}"] or [] if t["item"] is not None}
        counts[None] = found[f"nulls_{key}"]
        out[key] = [(item, ceil(n / fair)) for item, n in counts.items() if n > fair]
    return out


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    heavy: Sequence[tuple[object, int]] = (),
    also: Sequence[str] = (),
    deal: bool = False,
) -> DataFrame:
    """Join ``left`` (any skew) with ``right`` (one row per key) on ``key``; how is inner or left.

    ``heavy``: (key, salts) of keys known to be heavy, at most MAX_HEAVY_KEYS. ``also``: further columns that are equal
    where the keys are; a filter on one of them reaches both sides. ``deal``: see ``dealt``, for a result that is grouped
    by the keys next.
    """
    keys = [key, *also]
    if how not in ("inner", "left"):
        raise ValueError(f"lookup_join supports inner and left, not {how!r}")
    if is_small(right):
        return left.join(F.broadcast(right), keys, how)
    if how == "inner":
        heavy = [(item, n) for item, n in heavy if item is not None]
    if not heavy:
        return (dealt(left, *keys) if deal else left).join(right, keys, how)
    if len(heavy) > MAX_HEAVY_KEYS + 1:
        raise ValueError(f"at most {MAX_HEAVY_KEYS} heavy keys")
    row_hash = F.xxhash64(*left.columns)
    null_salts = dict(heavy).get(None, 1)
    table = left.sparkSession.createDataFrame(
        [(item, n) for item, n in heavy if item is not None],
        f"`{key}` {left.schema[key].dataType.simpleString()}, _salts int",
    )
    # a NULL key meets nothing, so its rows may go anywhere
    salts = F.when(F.col(key).isNull(), null_salts).otherwise(F.coalesce("_salts", F.lit(1)))
    salt = F.when(salts > 1, F.pmod(row_hash, salts).cast("int")).otherwise(0)
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_left = left.join(F.broadcast(table), key, "left").withColumn("_salt", salt).drop("_salts")
    salted_right = right.join(F.broadcast(table), key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def count_by_key(df: DataFrame, key: Column | str, name: str = "key") -> DataFrame:
    """(name, rows): one row per key value, counted before the shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("rows"))


def match_counts(
    child: DataFrame, child_key: Column | str, parent: DataFrame, parent_key: Column | str
) -> DataFrame:
    """(key, rows, matched): child rows per key value and whether the parent has that key.

    NULL keys are kept as unmatched. Both sides are aggregated to one row per key first.
    """
    parent_key = F.col(parent_key) if isinstance(parent_key, str) else parent_key
    keys = parent.select(parent_key.alias("key")).filter("key is not null").distinct()
    return count_by_key(child, child_key).join(keys.withColumn("matched", F.lit(1)), "key", "left").select(
        "key", "rows", F.coalesce("matched", F.lit(0)).alias("matched")
    )
