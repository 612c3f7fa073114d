"""Compare registered queries with their reference SQL: names, types and values, ignoring row order.

    python -m tests.compare [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _types(schema: pa.Schema) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "").replace("[ns]", "[us]") for f in schema}


def _rows(table: pa.Table, names: list[str]) -> Counter:
    columns = [table.column(n).to_pylist() for n in names]
    return Counter(zip(*columns, strict=True)) if columns else Counter()


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """(row count, list of differences; empty when equal)."""
    mine = spark_df.toArrow()
    theirs = con.sql(sql).to_arrow_table()
    found = []
    a, b = _types(mine.schema), _types(theirs.schema)
    if set(a) != set(b):
        return mine.num_rows, [f"columns {sorted(a)} != {sorted(b)}"]
    found += [f"type of {n}: {a[n]} != {b[n]}" for n in sorted(a) if a[n] != b[n]]
    names = sorted(a)
    left, right = _rows(mine, names), _rows(theirs, names)
    if left != right:
        extra, missing = left - right, right - left
        found.append(
            f"rows {mine.num_rows} vs {theirs.num_rows}; {names}\n   only spark: {list(extra.items())[:3]}"
            f"\n   only duckdb: {list(missing.items())[:3]}"
        )
    return mine.num_rows, found


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = session(), duck(folder)
    todo, sql = queries(), oracle_sql()
    wanted = argv[1:] or list(todo)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name not in sql:
                rows, found = todo[name](spark, folder).count(), ["NO ORACLE"]
            else:
                rows, found = differences(todo[name](spark, folder), con, sql[name])
        except Exception as e:  # noqa: BLE001 - report and go on
            rows, found = -1, [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name:36s} {rows:8d} rows {time.time() - start:6.2f}s", *found, sep="\n   " if found else " ", flush=True)
    extra = set(sql) - set(todo)
    print(f"{len(wanted) - bad}/{len(wanted)} equal; oracle without query: {sorted(extra)}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
