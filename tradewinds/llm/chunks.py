"""Deal a corpus out in chunks, and ask questions about all of it that are keyed by 64-bit names.

A chunk is a set of documents of about ``CHUNK_BYTES`` bytes of text, chosen by a hash of the document id alone, so
any retried task meets the same chunk. A task names what its chunk holds, sends every distinct name once (the
combining happens before the shuffle, so a name in a third of all rows costs one entry per chunk), and gets the
answers back in the order in which it asked. Names are dealt to as many buckets as there are chunks; both counts
follow the bytes of the input, so memory of a task does not.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
CHUNK, BUCKET = "_chunk", "_bucket"
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def give_back() -> None:
    """Return freed memory to the system. A worker lives on after its task, beside those of the tasks that follow, and
    memory that it has freed but kept counts as used."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def and_give_back(run: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    out = run(*tables)
    give_back()
    return out


def chunk_count(docs: DataFrame, text: str) -> int:
    """Chunks for the text at hand, at least twice the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(total) // CHUNK_BYTES))


def in_chunks(docs: DataFrame, doc_id: str, text: str, chunks: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, text and kept columns of every document with its chunk; rows without an id are spread by their text."""
    spread = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.col(text)))
    return docs.select(
        F.pmod(spread, F.lit(chunks)).cast("int").alias(CHUNK),
        F.col(doc_id).cast("long").alias("_id"),
        F.col(text).cast("binary").alias("_text"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    ).repartition(F.col(CHUNK))


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return (((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def by_bucket(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings the names of a bucket together and keeps the order within it; the buckets met and where
    each begins (one more entry: the end)."""
    to = bucket_of(names, buckets)
    order = np.argsort(to, kind="stable")
    met, begin = np.unique(to[order], return_index=True)
    return order, met, np.append(begin, len(order))


def texts_of(table: pa.Table, column: str = "_text") -> list[bytes]:
    """The texts as bytes; null as empty."""
    return [t or b"" for t in table.column(column).to_pylist()]


def numbers(blobs: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=kind) for b in blobs.to_pylist()]
