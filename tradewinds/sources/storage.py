"""Stored tables: Parquet files below a folder, and a pointer file that says which of them are the table.

Rows are written to a folder of a version first. Only then is the pointer replaced, by renaming a new one over it, so
whatever fails before leaves the table as it was, and there is no moment without a table. The pointer names the version
of every partition, so some partitions can be rewritten without touching the others.

A table may be bucketed by a key. Spark keeps buckets in its catalog, so such a table is registered there under a name
of its own as an external table; the pointer holds what is needed to register it again in a later session.
"""

from __future__ import annotations

import atexit
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewinds.operators.joins import heavy_keys_of

CURRENT = "_CURRENT"
VERSION = "_version"


@dataclass(frozen=True)
class Table:
    """What the pointer says: schema, layout, heavy keys by column, metrics taken while it was written, and the version of
    each partition folder ('' where the table has no partitions)."""

    schema: str
    partition_by: list[str] = field(default_factory=list)
    bucket_by: str | None = None
    buckets: int = 0
    heavy: dict[str, list] = field(default_factory=dict)
    metrics: dict[str, str | None] = field(default_factory=dict)
    parts: dict[str, str] = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    def heavy_keys(self, key: str) -> list[tuple[object, int]]:
        return [(item, salts) for item, salts in self.heavy.get(key, [])]


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def overwrite_table(
    df: DataFrame,
    path: str,
    schema: T.StructType | None = None,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    bucket_by: str | None = None,
    buckets: int = 0,
    heavy: Sequence[str] = (),
    metrics: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Full refresh of a table; returns it as written. Repeating it gives the same table.

    A failed write leaves the old rows in place; those written before stay for readers that hold them until the next write.

    Rows are rebalanced to files of the advised size, with ``partition_by`` by those columns *and* within them, so
    neither thousands of tiny files nor one giant writer task appear for a heavy month. ``cluster_by`` sorts the rows of
    each file, without a shuffle, so that filters on those columns skip row groups.

    With ``bucket_by`` and ``buckets`` equal keys are in equal buckets, so tables bucketed alike join on that key without
    a shuffle. Buckets are spread over writers by their size, too; a heavy bucket is several files.

    For the columns named in ``heavy`` the keys that hold a large share of the rows are looked for in what was written and
    kept beside it, for joins to salt them without a job of their own. ``metrics``, aggregates over all rows, are taken in
    passing and kept beside it, too.
    """
    spark = df.sparkSession
    out = df if schema is None else conform(df, schema)
    table = Table(out.schema.json(), list(partition_by), bucket_by if buckets else None, buckets if bucket_by else 0)
    seen = Observation() if metrics else None
    version = _write(out, path, table, cluster_by, seen, metrics)
    parts = {p: version for p in _partitions(spark, f"{path}/{VERSION}={version}", table.partition_by)}
    found = {name: None if value is None else str(value) for name, value in seen.get.items()} if seen else {}
    table = replace(table, parts=parts, metrics=found)
    if heavy:
        rows = _rows(spark, path, table)
        table = replace(table, heavy={key: [list(k) for k in found] for key, found in heavy_keys_of(rows, heavy).items()})
    _point_to(spark, path, table)
    return read_table(spark, path)


def overwrite_partitions(df: DataFrame, path: str, cluster_by: Sequence[str] = (), also: Sequence[str] = ()) -> DataFrame:
    """Replace the partitions of a stored table that ``df`` has rows of, and add those that are new; the other partitions
    keep their files, which are not read. Partition folders named in ``also`` (as "month=1995-03") are replaced, too, so
    they go if ``df`` has no row of them. Heavy keys stay those of the last full refresh; metrics of the whole table, which
    this write does not see, go."""
    spark, table = df.sparkSession, stored_table(df.sparkSession, path)
    if table is None or not table.partition_by:
        raise ValueError(f"no table with partitions at {path}")
    version = _write(conform(df, table.struct), path, table, cluster_by)
    new = {p: version for p in _partitions(spark, f"{path}/{VERSION}={version}", table.partition_by)}
    kept = {p: v for p, v in table.parts.items() if p not in also}
    _point_to(spark, path, replace(table, metrics={}, parts={**kept, **new}))
    return read_table(spark, path)


def _write(
    out: DataFrame,
    path: str,
    table: Table,
    cluster_by: Sequence[str],
    seen: Observation | None = None,
    metrics: Mapping[str, Column] | None = None,
) -> str:
    spark, version = out.sparkSession, uuid.uuid4().hex
    if table.buckets:
        numbered = out.withColumn("_bucket", F.pmod(F.hash(table.bucket_by), F.lit(table.buckets)))
        out = numbered.hint("rebalance", *table.partition_by, "_bucket").drop("_bucket")
    else:
        out = out.hint("rebalance", *table.partition_by)
        if cluster_by:
            out = out.sortWithinPartitions(*table.partition_by, *cluster_by)
    if seen:
        # past the shuffle, in the tasks that write: what a lost task saw is not counted
        out = out.observe(seen, *[c.alias(name) for name, c in metrics.items()])
    writer = out.write.partitionBy(*table.partition_by)
    target = f"{path}/{VERSION}={version}"
    if not table.buckets:
        writer.parquet(target)
        return version
    writer = writer.bucketBy(table.buckets, table.bucket_by)
    if cluster_by:
        writer = writer.sortBy(*cluster_by)
    name = f"written_{version}"
    writer.format("parquet").option("path", target).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    return version


def _partitions(spark: SparkSession, folder: str, columns: Sequence[str]) -> list[str]:
    """The partition folders below ``folder``, relative to it."""
    found = [""]
    for _ in columns:
        below = []
        for start in found:
            files, where = hadoop_path(spark, f"{folder}/{start}" if start else folder)
            names = [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()]
            below += [f"{start}/{n}".lstrip("/") for n in names if "=" in n]
        found = below
    return sorted(found)


def _point_to(spark: SparkSession, path: str, table: Table) -> None:
    """Make ``table`` the current one by a rename, then remove what neither it nor the one before needs."""
    files, where = hadoop_path(spark, path)
    before = stored_table(spark, path)
    beside = hadoop_path(spark, f"{path}/{CURRENT}-{uuid.uuid4().hex}")[1]
    stream = files.create(beside, True)
    stream.write(bytearray(json.dumps(asdict(table)).encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(beside), files.makeQualified(hadoop_path(spark, f"{path}/{CURRENT}")[1]), over)
    needed = {(v, p) for t in (table, before) if t for p, v in t.parts.items()}
    versions = {v for v, _ in needed}
    for status in files.listStatus(where):
        name = status.getPath().getName()
        if not name.startswith(f"{VERSION}="):
            continue
        version = name.removeprefix(f"{VERSION}=")
        if version not in versions:
            files.delete(status.getPath(), True)
        elif table.partition_by:
            for part in _partitions(spark, f"{path}/{name}", table.partition_by):
                if (version, part) not in needed:
                    files.delete(hadoop_path(spark, f"{path}/{name}/{part}")[1], True)


def stored_table(spark: SparkSession, path: str) -> Table | None:
    """What the pointer of the table at ``path`` says; None before the first write."""
    files, pointer = hadoop_path(spark, f"{path}/{CURRENT}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return Table(**json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``overwrite_table``, with its partitions and buckets."""
    table = stored_table(spark, path)
    if table is None:
        raise ValueError(f"no table at {path}")
    return _rows(spark, path, table)


def _rows(spark: SparkSession, path: str, table: Table) -> DataFrame:
    if table.buckets and table.parts:
        return spark.table(_registered(spark, path, table)).select(table.struct.names)
    if not table.partition_by:
        return spark.read.schema(table.struct).parquet(*[f"{path}/{VERSION}={v}" for v in table.parts.values()])
    folders = [f"{path}/{VERSION}={v}/{p}" for p, v in table.parts.items()]
    if not folders:
        return spark.createDataFrame([], table.struct)
    marked = T.StructType([*table.struct.fields, T.StructField(VERSION, T.StringType())])
    return spark.read.schema(marked).option("basePath", path).parquet(*folders).drop(VERSION)


def _registered(spark: SparkSession, path: str, table: Table) -> str:
    """The name under which the catalog holds this state of a bucketed table; the files stay when it goes."""
    state = uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([path, asdict(table)], sort_keys=True))
    name = f"stored_{state.hex}"
    if spark.catalog.tableExists(name):
        return name
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.struct.fields)
    partitions = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in table.partition_by)})" if table.partition_by else ""
    buckets = f"CLUSTERED BY (`{table.bucket_by}`) INTO {table.buckets} BUCKETS"
    first = f"{path}/{VERSION}={next(iter(table.parts.values()))}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {partitions} {buckets} LOCATION '{first}'")
    atexit.register(_forget, spark, name)
    for part, version in table.parts.items() if table.partition_by else ():
        values = ", ".join(f"`{c}` = '{v}'" for c, v in (folder.split("=", 1) for folder in part.split("/")))
        spark.sql(f"ALTER TABLE {name} ADD PARTITION ({values}) LOCATION '{path}/{VERSION}={version}/{part}'")
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")
    return name


def _forget(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001 - the session has ended before the program
        pass
