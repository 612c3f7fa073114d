"""Benchmark decontamination by Wu-Manber search over words.

All windows of one length are searched together. A table over blocks of two words tells how far the search may jump:
the distance from the block to the end of the window that holds it nearest to its end, or the whole length if no
window holds it. Where the distance is 0, the windows that end in this block are compared word by word. Many
stretches of text advance side by side, so a step is one array operation.

The benchmark is the stated set of queries. It goes to the tasks in blocks of about ``BLOCK_BYTES`` bytes of text, one
after the other: what a block finds is written before the next one is read, and the block is taken from the executors
again, so that the driver and each of them hold one block whatever the size of the benchmark. Only rows with hits are
written; in the end they meet the documents by a 128-bit name of the row's id and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tradewinds.llm.chunks import give_back, texts_of
from tradewinds.llm.scratch import written
from tradewinds.llm.words import ALPHANUMERIC, Words, mix, name_words

WINDOW = 13
BLOCK_BYTES = 2 << 20
_STRETCH = 256  # window starts that one lane of the search looks after
_SPANS = ArrayType(StructType().add("from", IntegerType()).add("to", IntegerType()))
_VOCABULARY_BITS, _SHIFT_BITS = 20, 20


class Patterns(NamedTuple):
    """Distinct windows of one length, ordered by the block they end in, and the items that hold each."""

    windows: np.ndarray
    block: int
    jumps: np.ndarray
    endings: np.ndarray
    begin: np.ndarray
    items: list[list[str]]


class Search(NamedTuple):
    words: np.ndarray
    slots: np.ndarray
    patterns: list[Patterns]


def _block_key(ids: np.ndarray, end: np.ndarray, block: int) -> np.ndarray:
    key = ids[end].astype(np.uint64)
    return mix(key + np.uint64(1)) if block == 1 else mix(key + (ids[end - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(1 << 32))


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)


def build_search(items: list[tuple[str, str | None]], size: int = WINDOW) -> Search:
    """Jump tables and buckets for the windows of ``items`` (id, text)."""
    words = name_words([(t or "").encode() for _, t in items], ALPHANUMERIC)
    vocabulary = np.unique(words.names)
    slots = np.full(1 << _VOCABULARY_BITS, -1, dtype=np.int32)
    # words of one slot stand side by side in the vocabulary, as both follow the leading bits
    place = (vocabulary >> np.uint64(64 - _VOCABULARY_BITS)).astype(np.int64)
    slots[place[::-1]] = np.arange(len(vocabulary), dtype=np.int32)[::-1]
    ids = np.searchsorted(vocabulary, words.names).astype(np.int32)
    holders: dict[int, dict[bytes, list[str]]] = {}
    for (item, _), a, b in zip(items, words.first[:-1], words.first[1:], strict=True):
        m = min(size, b - a)
        for start in range(a, b - m + 1) if m else ():
            found = holders.setdefault(int(m), {}).setdefault(ids[start : start + m].tobytes(), [])
            if item not in found[-1:]:
                found.append(item)
    return Search(vocabulary, slots, [_patterns(m, held) for m, held in sorted(holders.items())])


def _patterns(m: int, held: dict[bytes, list[str]]) -> Patterns:
    windows = np.frombuffer(b"".join(held), dtype=np.int32).reshape(-1, m)
    block = min(2, m)
    jumps = np.full(1 << _SHIFT_BITS, m - block + 1, dtype=np.min_scalar_type(m))
    for end in range(block - 1, m):
        key = _slot(_block_key(windows.ravel(), np.arange(len(windows)) * m + end, block))
        jumps[key] = np.minimum(jumps[key], m - 1 - end)
    key = _block_key(windows.ravel(), np.arange(len(windows)) * m + m - 1, block)
    order = np.argsort(key, kind="stable")
    endings, begin = np.unique(key[order], return_index=True)
    lists = list(held.values())
    return Patterns(windows[order], block, jumps, endings, np.append(begin, len(order)), [lists[i] for i in order])


def word_ids(search: Search, names: np.ndarray) -> np.ndarray:
    """Numbers of the benchmark's words; -1 for any other word."""
    at = search.slots[(names >> np.uint64(64 - _VOCABULARY_BITS)).astype(np.int64)]
    ids = np.full(len(names), -1, dtype=np.int32)
    look = np.flatnonzero(at >= 0)
    at = at[look]
    while len(look):
        same = search.words[at] == names[look]
        ids[look[same]] = at[same]
        at, look = at[~same] + 1, look[~same]
        stay = at < len(search.words)
        at, look = at[stay], look[stay]
        stay = search.words[at] <= names[look]
        at, look = at[stay], look[stay]
    return ids


def occurrences(p: Patterns, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the stretches of ``ids`` that equal a window, and the number of that window."""
    m = p.windows.shape[1]
    n = np.maximum(np.diff(first) - m + 1, 0)
    lanes = -(-n // _STRETCH)
    text = np.repeat(np.arange(len(n)), lanes)
    offset = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * _STRETCH
    end = first[text] + offset + m - 1
    stop = first[text] + np.minimum(offset + _STRETCH, n[text]) + m - 1
    candidates = []
    while len(end):
        key = _block_key(ids, end, p.block)
        jump = p.jumps[_slot(key)]
        at = jump == 0
        if at.any():
            candidates.append((end[at], key[at]))
        end = end + np.maximum(jump, 1).astype(np.int64)
        go = end < stop
        if not go.all():
            end, stop = end[go], stop[go]
    if not candidates or not len(p.endings):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    end, key = (np.concatenate(c) for c in zip(*candidates, strict=True))
    bucket = np.minimum(np.searchsorted(p.endings, key), len(p.endings) - 1)
    same = p.endings[bucket] == key
    end, bucket = end[same], bucket[same]
    many = p.begin[bucket + 1] - p.begin[bucket]
    start = np.repeat(end - m + 1, many)
    number = np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(p.begin[bucket], many)
    for k in range(m):
        same = ids[start + k] == p.windows[number, k]
        start, number = start[same], number[same]
    return start, number


def find_hits(search: Search, words: Words) -> tuple[np.ndarray, list[set[str]]]:
    """Which words lie inside an occurrence, and the items found in each text."""
    ids = word_ids(search, words.names)
    step = np.zeros(len(ids) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
    for p in search.patterns:
        start, number = occurrences(p, ids, words.first)
        np.add.at(step, start, 1)
        np.add.at(step, start + p.windows.shape[1], -1)
        where = np.searchsorted(words.first, start, side="right") - 1
        for text, k in set(zip(where.tolist(), number.tolist(), strict=True)):
            items[text].update(p.items[k])
    return np.cumsum(step[:-1]) > 0, items


def _searching(shared, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                words = name_words(texts_of(pa.Table.from_batches([batch]), "_text"), ALPHANUMERIC)
                hit, items = find_hits(search, words)
                turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                text_of = np.searchsorted(words.first, turns[0::2], side="right") - 1
                spans: list[list] = [[] for _ in items]
                for text, a, b in zip(text_of.tolist(), turns[0::2].tolist(), turns[1::2].tolist(), strict=True):
                    # a run of hit words may go on into the next texts
                    while True:
                        edge = int(words.first[text + 1])
                        lower = int(words.first[text])
                        if min(b, edge) > a:
                            spans[text].append({"from": a - lower, "to": min(b, edge) - lower})
                        if b <= edge:
                            break
                        a, text = edge, text + 1
                keep = [c for c in kinds.names if c not in ("_spans", "_items", "_n_words")]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).cast(kinds.field(c).type) for c in keep],
                        pa.array(spans, kinds.field("_spans").type),
                        pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                        pa.array(words.counts, pa.int64()),
                    ],
                    names=kinds.names,
                )
        give_back()

    return run


def _joined(spans: Column) -> Column:
    """Spans in order, those that touch or overlap as one."""
    last = lambda done: F.element_at(done, -1)
    wider = lambda done, s: F.struct(last(done)["from"].alias("from"), F.greatest(last(done)["to"], s["to"]).alias("to"))
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(_SPANS),
        lambda done, s: F.when(
            F.coalesce(F.try_element_at(done, F.lit(-1))["to"] >= s["from"], F.lit(False)),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider(done, s))),
        ).otherwise(F.concat(done, F.array(s))),
    )


def _found_by_further(rows: DataFrame, load: Callable[[int], Search], blocks: int) -> DataFrame:
    """(_name_a, _name_b, _more) for rows in which a block from the second on is found: the set of finds of the blocks."""
    spark, parts = rows.sparkSession, []
    kinds = rows.select("_name_a", "_name_b").schema.add("_spans", _SPANS).add("_items", ArrayType(StringType())).add("_n_words", "long")
    for k in range(1, blocks):
        shared = spark.sparkContext.broadcast(load(k))
        hits = rows.select("_name_a", "_name_b", "_text").mapInArrow(_searching(shared, to_arrow_schema(kinds)), kinds)
        parts.append(written(hits.filter(F.size("_items") > 0).drop("_n_words"), "decontamination"))
        shared.destroy()
    # copies of a row find the same, so there are at most as many finds of a name as blocks
    return reduce(DataFrame.union, parts).groupBy("_name_a", "_name_b").agg(F.collect_set(F.struct("_spans", "_items")).alias("_more"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    percent: int = 5,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Find the windows of ``benchmark`` in ``docs``.

    Words are runs of digits, letters and characters outside ASCII, with A-Z lower-cased. A window is ``size``
    consecutive words of an item; an item of fewer, but not none, is one window. Returns per row: the id, the ``keep``
    columns, n_words, hit_spans (from, to: numbers of words, ``to`` excluded), n_hit, items (ids of the items found, as
    sorted strings) and contaminated (some hit, and at least ``percent`` of the words). Null and empty texts have no
    words; items without id or words are found nowhere. Rows are looked at one by one, so repeated rows and ids
    without value stay as they are. An empty benchmark contaminates nothing. The benchmark is searched for in blocks of
    about ``BLOCK_BYTES`` bytes of text; the blocks change nothing in the result.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("_item"), F.col(item_text).cast("string").alias("_text")).dropna()
    total = items.agg(F.sum(F.octet_length("_text") + 32)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))

    def load(block: int) -> Search:
        part = items.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block)
        return build_search([tuple(r) for r in part.distinct().sort("_item", "_text").collect()], size)

    rows = docs.select(
        F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep]
    )
    if blocks > 1:
        named = [F.xxhash64(F.lit(salt), F.col("_id").cast("string"), F.col("_id").isNull(), "_text") for salt in ("a", "b")]
        rows = rows.withColumns(dict(zip(("_name_a", "_name_b"), named, strict=True)))
    kept = [c for c in rows.columns if c != "_text"]
    kinds = rows.select(*kept).schema.add("_spans", _SPANS).add("_items", ArrayType(StringType())).add("_n_words", "long")
    more = _found_by_further(rows, load, blocks) if blocks > 1 else None
    shared = docs.sparkSession.sparkContext.broadcast(load(0))
    found = rows.mapInArrow(_searching(shared, to_arrow_schema(kinds)), kinds)
    if more is not None:
        found = found.join(more, ["_name_a", "_name_b"], "left").withColumn("_more", F.coalesce("_more", F.array()))
        found = found.withColumns(
            {
                "_spans": _joined(F.concat("_spans", F.flatten(F.col("_more._spans")))),
                "_items": F.array_sort(F.array_distinct(F.concat("_items", F.flatten(F.col("_more._items"))))),
            }
        )
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select(
        F.col("_id").alias(doc_id),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        F.col("_n_words").alias("n_words"),
        F.col("_spans").alias("hit_spans"),
        n_hit.alias("n_hit"),
        F.col("_items").alias("items"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("_n_words"))).alias("contaminated"),
    )
