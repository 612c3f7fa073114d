"""Lines of CSV files put together to records, where files of any size are read by as many tasks as they have splits.

A record may go on over line ends inside quotes, so whether a line starts a record depends on all lines before it in its
file. What a line does to that state is one of four things: it keeps it, turns it, or leaves it open or closed whatever
it was. Such steps can be put together in any grouping: first within a segment of a split, some thousand lines, for both
states it may begin in, then over the segments of a file, which are few. With the state at its start every segment finds
its records by itself, and only lines of records of several lines are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewinds.operators.joins import dealt

FILE, BLOCK, SEGMENT, AT, POSITION, RECORD, LINE = "_file", "_block", "_segment", "_at", "_position", "_record", "_line"
SEGMENT_BITS = 14  # a segment has 2**14 lines at most
TEXT_BYTES = 16 << 20  # of lines to a partition, where there are many
_FIELD = '(^|,)"[^"]*+"'


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_file, _block, _segment, _at, _line): every line with its file, the place of its split there, its segment of the
    split and a number that rises within a split, line by line. Segments rise with it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    numbered = lines.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(AT),
        F.col("value").alias(LINE),
    )
    return numbered.select(FILE, BLOCK, F.shiftright(AT, SEGMENT_BITS).alias(SEGMENT), AT, LINE)


def unquoted(text: Column) -> Column:
    """The text without quoted fields; of a quote that stays open, what follows is still there."""
    return F.regexp_replace(F.replace(text, F.lit('""'), F.lit("")), _FIELD, "$1")


def ends_open(text: Column) -> Column:
    """Whether a text that begins outside quotes ends inside."""
    return F.when(F.contains(text, F.lit('"')), F.rlike(unquoted(text), F.lit('(^|,)"'))).otherwise(F.lit(False))


def field_count(record: Column) -> Column:
    """Fields of a record: one more than the commas outside quoted fields."""
    return (F.length(F.regexp_replace(unquoted(record), "[^,]+", "")) + 1).cast("int")


def _parity(number: Column) -> Column:
    return F.pmod(number, F.lit(2))


def _with_effects(lines: DataFrame) -> DataFrame:
    """For each line: _after (state that its segment's lines up to it leave, null if that depends on the segment's start)
    and _turns (how often they turn the state since the segment's start), both before and after the line."""
    in_segment = Window.partitionBy(FILE, BLOCK, SEGMENT).orderBy(AT)
    before = in_segment.rowsBetween(Window.unboundedPreceding, -1)
    if_closed = ends_open(F.col(LINE)).cast("int")
    if_open = F.when(F.contains(LINE, F.lit('"')), ends_open(F.concat(F.lit('"'), LINE))).otherwise(F.lit(True)).cast("int")
    seen = lines.withColumn("_if_closed", if_closed).withColumn("_if_open", if_open)
    turns = (F.col("_if_closed") == 1) & (F.col("_if_open") == 0)
    seen = seen.withColumn("_turn", turns.cast("int"))
    seen = seen.withColumn("_turns", F.sum("_turn").over(in_segment.rowsBetween(Window.unboundedPreceding, 0)))
    # a line with one outcome fixes the state; its outcome less the turns so far is what later lines add their turns to
    fixed = F.when(F.col("_if_closed") == F.col("_if_open"), _parity(F.col("_if_closed") + F.col("_turns")))
    seen = seen.withColumn("_fixed", fixed).withColumn("_base", F.last("_fixed", ignorenulls=True).over(before))
    return seen.withColumn("_turned", F.col("_turns") - F.col("_turn")).drop("_turn")


def _state(start: Column) -> Column:
    return _parity(F.coalesce(F.col("_base").cast("long"), start) + F.col("_turned"))


def _segments(seen: DataFrame) -> DataFrame:
    """One row a segment: the number of its split's first line (_from), its _start state, the record it begins in
    (_carried), and of its file, the first line that is not empty (_header) and whether lines end in CR LF (_crlf)."""
    begins = [F.when(_state(F.lit(s)) == 0, F.col(AT)) for s in (0, 1)]
    per_segment = seen.groupBy(FILE, BLOCK, SEGMENT).agg(
        F.max_by(F.coalesce("_fixed", "_base"), AT).alias("_kept"),
        F.max("_turns").alias("_all_turns"),
        F.max(begins[0]).alias("_last_if_closed"),
        F.max(begins[1]).alias("_last_if_open"),
        F.min_by(F.endswith(LINE, F.lit("\r")), AT).alias("_cr"),
        F.min(F.when(~F.col(LINE).isin("", "\r"), F.col(AT))).alias("_first"),
        F.min(AT).alias("_from"),
    )
    per_segment = per_segment.withColumn("_from", F.min("_from").over(Window.partitionBy(FILE, BLOCK)))
    of_file = Window.partitionBy(FILE).orderBy(BLOCK, SEGMENT)
    before, whole = of_file.rowsBetween(Window.unboundedPreceding, -1), of_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = F.sum("_all_turns").over(of_file.rowsBetween(Window.unboundedPreceding, 0))
    out = per_segment.withColumn("_file_turns", turns)
    fixed = F.when(F.col("_kept").isNotNull(), _parity(F.col("_kept") + F.col("_all_turns") + F.col("_file_turns")))
    out = out.withColumn("_file_fixed", fixed)
    start = _parity(F.coalesce(F.last("_file_fixed", ignorenulls=True).over(before), F.lit(0)) + F.col("_file_turns") - F.col("_all_turns"))
    out = out.withColumn("_start", start)
    last = F.when(F.col("_start") == 0, F.col("_last_if_closed")).otherwise(F.col("_last_if_open"))
    place = F.struct(last.alias(AT), F.col(BLOCK), (last - F.col("_from") + 1).alias(POSITION))
    out = out.withColumn("_last", F.when(last.isNotNull(), place))
    return out.select(
        FILE,
        BLOCK,
        SEGMENT,
        "_from",
        "_start",
        F.last("_last", ignorenulls=True).over(before).alias("_carried"),
        F.first("_first", ignorenulls=True).over(whole).alias("_header"),
        F.first("_cr").over(whole).alias("_crlf"),
    )


def quoted_records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """(_file, _block, _position, _record): the records of files, without their headers and empty lines.

    _position is the line of its split, counted from 1, in which the record begins. Line breaks inside quotes are kept,
    those of a file with CR LF as line feeds. A quote that is never closed makes the rest of its file one record.
    """
    seen = _with_effects(dealt(read_lines(spark, path), FILE, BLOCK, SEGMENT, each=TEXT_BYTES))
    lines = seen.join(_segments(seen), [FILE, BLOCK, SEGMENT])
    text = F.when(F.col("_crlf"), F.regexp_replace(F.col(LINE), "\r$", "")).otherwise(F.col(LINE))
    lines = lines.withColumn(LINE, text).withColumn("_open", _state(F.col("_start")))
    # where the record of a line begins: (number, split, line of the split)
    here = F.struct(F.col(AT), F.col(BLOCK), (F.col(AT) - F.col("_from") + 1).alias(POSITION))
    so_far = Window.partitionBy(FILE, BLOCK, SEGMENT).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("_open") == 0, here), ignorenulls=True).over(so_far)
    lines = lines.withColumn("_begun", F.coalesce(begun, F.col("_carried")))
    if header:
        lines = lines.filter(F.col(f"_begun.{AT}") != F.col("_header"))
    alone = (F.col("_open") == 0) & (F.col("_if_closed") == 0)
    place = [F.col(f"_begun.{BLOCK}").alias(BLOCK), F.col(f"_begun.{POSITION}").alias(POSITION)]
    single = lines.filter(alone & (F.col(LINE) != "")).select(FILE, *place, F.col(LINE).alias(RECORD))
    parts = F.array_sort(F.collect_list(F.struct(BLOCK, AT, LINE)))
    # the files are below these rows twice
    several = dealt(lines.filter(~alone), FILE, "_begun", each=2 * TEXT_BYTES).groupBy(FILE, "_begun").agg(parts.alias("_parts"))
    joined = F.array_join(F.transform("_parts", lambda p: p[LINE]), "\n")
    return single.unionByName(several.select(FILE, *place, joined.alias(RECORD)))
