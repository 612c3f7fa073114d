"""CSV -> raw layer. Comma separated, double quotes, '\\n' line ends, one header row, UTF-8, no cleaning."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewinds.sources.csv_records import AT, BLOCK, FILE, POSITION, RECORD, ends_open, field_count, quoted_records
from tradewinds.sources.schemas import MULTILINE_TABLES, RAW_SCHEMAS
from tradewinds.sources.sinks import scratch_folder

CORRUPT = "_corrupt_record"
_LAYOUT = {"sep": ",", "quote": '"', "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def blank_numeric_to_null(df: DataFrame, columns: dict[str, T.DataType]) -> DataFrame:
    """Type text columns; blank text becomes NULL and so does text that is no number."""
    typed = {name: F.nullif(F.trim(F.col(name)), F.lit("")).try_cast(kind) for name, kind in columns.items()}
    return df.withColumns(typed)


def _finish(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns keep '' (the reader reports an empty field as NULL), numbers get NULL."""
    text = {f.name: F.coalesce(F.col(f.name), F.lit("")) for f in schema.fields if isinstance(f.dataType, T.StringType)}
    numbers = {f.name: f.dataType for f in schema.fields if not isinstance(f.dataType, T.StringType)}
    return blank_numeric_to_null(df.withColumns(text), numbers).select(*schema.names)


def load_csv_raw(spark: SparkSession, path: str | list[str], schema: T.StructType, **options: str) -> DataFrame:
    """One row per line. With '\\n' as the only line end a CRLF file keeps its '\\r' for the cleaning step."""
    reader = spark.read.schema(_as_text(schema)).options(header=True, lineSep="\n", **_LAYOUT)
    return _finish(reader.options(**options).csv(path), schema)


def load_csv_multiline(spark: SparkSession, path: str | list[str], schema: T.StructType, **options: str) -> DataFrame:
    """As ``load_csv_raw`` for text holding commas, doubled quotes and line breaks inside quotes.

    Files are split like any other, however large; see ``csv_records``. Rows are those of Spark's own multi-line
    reader, which takes a file as one task.
    """
    parsed = F.from_csv(F.col(RECORD), _ddl(_as_text(schema)), {**_LAYOUT, **options})
    return _finish(quoted_records(spark, path).select(parsed.alias("_row")).select("_row.*"), schema)


class Loaded(NamedTuple):
    """Rows with the right number of fields, and the others with their place and what is wrong with them."""

    rows: DataFrame
    rejects: DataFrame


def load_checked(
    spark: SparkSession, name: str, path: str | list[str], storage: str | None = None, header: bool = True
) -> Loaded:
    """Load a raw table and keep apart the records that do not have its fields. The files are read once.

    What is parsed is written below ``storage`` (a scratch folder unless given), records to be rejected in a folder of
    their own. rejects: (table_name, file, split_start, position, n_fields, reason, record). Byte split_start of the file is
    where the split begins whose lines position counts from 1; past the start of a file these are the lines after the
    first line end. Where no record can have several lines, rows are counted and neither a header nor blank lines.
    """
    schema = RAW_SCHEMAS[name]
    marked = T.StructType([*_as_text(schema).fields, T.StructField(CORRUPT, T.StringType(), True)])
    if name in MULTILINE_TABLES:
        parsed = F.from_csv(F.col(RECORD), _ddl(marked), {**_LAYOUT, "columnNameOfCorruptRecord": CORRUPT})
        found = quoted_records(spark, path, header).withColumn("_row", parsed).select(FILE, BLOCK, POSITION, RECORD, "_row.*")
        text = F.col(RECORD)
    else:
        reader = spark.read.schema(marked).options(header=header, lineSep="\n", columnNameOfCorruptRecord=CORRUPT, **_LAYOUT)
        place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK)]
        found = reader.csv(path).select("*", *place).withColumn(AT, F.monotonically_increasing_id())
        text = F.col(CORRUPT)
    n, fields = field_count(text), len(schema)
    reason = (
        F.when(ends_open(text), "quote left open")
        .when(n < fields, "too few fields")
        .when(n > fields, "too many fields")
        .when(F.col(CORRUPT).isNotNull(), "malformed")
    )
    found = found.withColumn("_reason", reason).withColumn("_rejected", F.col("_reason").isNotNull())
    found = found.withColumn(CORRUPT, F.when(F.col("_rejected"), text)).drop(RECORD)
    target = storage or scratch_folder(spark, f"checked-{name}")
    found.write.mode("overwrite").partitionBy("_rejected").parquet(target)
    stored = spark.read.schema(found.schema).parquet(target)
    rejects = stored.filter("_rejected")
    if AT in found.columns:
        begin = stored.groupBy(FILE, BLOCK).agg(F.min(AT).alias("_from"))
        rejects = rejects.join(begin, [FILE, BLOCK]).withColumn(POSITION, F.col(AT) - F.col("_from") + 1)
    rejects = rejects.select(
        F.lit(name).alias("table_name"),
        F.col(FILE).alias("file"),
        F.col(BLOCK).alias("split_start"),
        F.col(POSITION).alias("position"),
        field_count(F.col(CORRUPT)).alias("n_fields"),
        F.col("_reason").alias("reason"),
        F.col(CORRUPT).alias("record"),
    )
    return Loaded(_finish(stored.filter("not _rejected").select(schema.names), schema), rejects)


def corrupt_rows(spark: SparkSession, name: str, path: str | list[str]) -> DataFrame:
    """(table_name, row_cnt, corrupt_cnt): rows whose number of fields is not that of the table.

    The loaders cut extra fields and fill missing ones; this says how often.
    """
    schema = T.StructType([*_as_text(RAW_SCHEMAS[name]).fields, T.StructField(CORRUPT, T.StringType(), True)])
    lines = {"multiLine": "true"} if name in MULTILINE_TABLES else {"lineSep": "\n"}
    read = spark.read.schema(schema).options(
        header=True, columnNameOfCorruptRecord=CORRUPT, **_LAYOUT, **lines
    )
    # a row is only parsed as far as its columns are asked for, so all of them are
    parsed = F.count_if(F.length(F.concat_ws("", *schema.names[:-1])) >= 0).alias("row_cnt")
    return read.csv(path).agg(parsed, F.count(CORRUPT).alias("corrupt_cnt")).select(F.lit(name).alias("table_name"), "row_cnt", "corrupt_cnt")


def load_raw_table(spark: SparkSession, name: str, path: str | list[str]) -> DataFrame:
    """Load one of the nine raw tables (see ``RAW_SCHEMAS``) from CSV files or folders."""
    load = load_csv_multiline if name in MULTILINE_TABLES else load_csv_raw
    return load(spark, path, RAW_SCHEMAS[name])


def load_raw_tables(spark: SparkSession, paths: dict[str, str | list[str]]) -> dict[str, DataFrame]:
    return {name: load_raw_table(spark, name, path) for name, path in paths.items()}


def write_csv_table(df: DataFrame, path: str) -> None:
    """Export in the layout the loaders read; quotes inside text are doubled."""
    df.write.mode("overwrite").options(
        header=True, sep=",", quote='"', escape='"', lineSep="\n", quoteAll=True, ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, emptyValue="", encoding="UTF-8",
    ).csv(path)
