"""Substring dedup by recompression.

Recompression shortens a text in rounds. A round first replaces every run of equal symbols by one symbol, then every
pair "left symbol, right symbol" by one, where a hash of the symbol says which side it can stand on. The symbol made
is a hash of what it replaces, so its name is the same in all tasks and documents. What happens between two symbols
depends on these two alone. Equal substrings therefore get equal symbols, but for some at their two ends. Popping
the end symbols of a window in each round until nothing is left gives a list of symbols that depends on the words of
the window and nothing around it; its hash names the window. A name shared by two documents reveals a repeat.

Names are 64 bits wide. Each task sends the distinct names of its chunk to buckets, a bucket finds the smallest
document of each name, and a bit per name comes back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewinds.llm.chunks import BUCKET, CHUNK, and_give_back, by_bucket, chunk_count, in_chunks, numbers, texts_of
from tradewinds.llm.words import join_names, mix, name_words, seeded

WINDOW = 13
_ASKED = f"{BUCKET} int, {CHUNK} int, _names binary, _owners binary, _runs binary"
_TOLD = f"{CHUNK} int, {BUCKET} int, _bits binary"


def window_names(words: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Names of the windows ``words[s:s + size]``."""
    symbols, left, right = words, start.copy(), start + size
    head = np.full(len(start), size, dtype=np.uint64)
    tail = np.zeros(len(start), dtype=np.uint64)
    name = np.zeros(len(start), dtype=np.uint64)
    live = np.arange(len(start))
    level = 0
    while len(live):
        # runs: those at the ends may go on outside the window, so what lies inside is popped
        begins = np.empty(len(symbols), dtype=bool)
        begins[:1] = True
        np.not_equal(symbols[1:], symbols[:-1], out=begins[1:])
        run_start = np.flatnonzero(begins)
        run = np.cumsum(begins) - 1
        run_end = np.append(run_start[1:], len(symbols))
        a, b = run[left], run[right - 1]
        head = join_names(head, symbols[left] + (np.minimum(run_end[a], right) - left).astype(np.uint64))
        more = b > a
        last = join_names(tail, symbols[right - 1] + (right - np.maximum(run_start[b], left)).astype(np.uint64))
        tail = np.where(more, last, tail)
        left, right = a + 1, b
        length = run_end - run_start
        symbols = symbols[run_start]
        symbols = np.where(length > 1, mix(symbols + length.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), symbols)
        # pairs: a right symbol at the left end may belong to a symbol outside, and a left symbol at the right end
        is_left = (seeded(symbols, level) & np.uint64(1)).astype(bool)
        top = len(symbols) - 1
        out = (left < right) & ~is_left[np.minimum(left, top)]
        head = np.where(out, join_names(head, symbols[np.minimum(left, top)]), head)
        left = left + out
        out = (left < right) & is_left[right - 1]
        tail = np.where(out, join_names(tail, symbols[right - 1]), tail)
        right = right - out
        paired = is_left[:-1] & ~is_left[1:]
        begins = np.append(True, ~paired)
        unit = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)
        wide = np.append(paired, False)[first]
        following = symbols[np.minimum(first + 1, top)]
        symbols, before = symbols[first], symbols
        symbols = np.where(wide, join_names(symbols, following), symbols)
        rest = left < right
        name[live[~rest]] = join_names(head[~rest], tail[~rest])
        live, head, tail = live[rest], head[rest], tail[rest]
        left, right = unit[left[rest]], unit[right[rest] - 1] + 1
        level += 1
        del before
    return name


def _windows(table: pa.Table, size: int):
    """Documents of a chunk in the order of their ids (those without id last), their words, window starts, the window's
    name, and for each distinct name in order of appearance where it appears first."""
    table = table.take(pc.sort_indices(table, sort_keys=[("_id", "ascending")], null_placement="at_end"))
    known = table.num_rows - table.column("_id").null_count
    # a column with nulls would turn into floating point, which has not all ids
    ids = table.column("_id").slice(0, known).to_numpy().astype(np.int64)
    texts = texts_of(table)
    words = name_words(texts)
    n = np.maximum(words.counts - size + 1, 0)
    n[known:] = 0
    owner = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(owner)) + np.repeat(words.first[:-1] - (np.cumsum(n) - n), n)
    names = window_names(words.names, start, size)
    return table, ids, texts, words, owner, start, names


def _ask(size: int, buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column(CHUNK)[0].as_py()
        table, ids, _, _, owner, _, names = _windows(table, size)
        distinct, first = np.unique(names, return_index=True)
        appear = np.argsort(first, kind="stable")
        distinct, holder = distinct[appear], owner[first[appear]]
        order, met, begin = by_bucket(distinct, buckets)
        rows = []
        for k, bucket in enumerate(met):
            at = order[begin[k] : begin[k + 1]]
            held = holder[at]
            turn = np.flatnonzero(np.diff(held, prepend=-1))
            runs = np.diff(np.append(turn, len(held))).astype(np.uint32)
            owners = ids[held[turn]].astype(np.int64)
            rows.append((int(bucket), chunk, distinct[at].tobytes(), owners.tobytes(), runs.tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[BUCKET, CHUNK, "_names", "_owners", "_runs"]
        )

    return lambda table: and_give_back(ask, table)


def _tell(table: pa.Table) -> pa.Table:
    """A bit per name asked about: set if a smaller document than the asking one holds it."""
    asked = numbers(table.column("_names"), np.uint64)
    names = np.concatenate(asked)
    owners = np.concatenate(
        [np.repeat(o, r) for o, r in zip(numbers(table.column("_owners"), np.int64), numbers(table.column("_runs"), np.uint32), strict=True)]
    )
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    least = np.minimum.reduceat(owners[order], begin)
    repeated = np.empty(len(names), dtype=bool)
    repeated[order] = np.repeat(least, np.diff(np.append(begin, len(names)))) < owners[order]
    edge = np.cumsum([len(a) for a in asked])[:-1]
    bits = [np.packbits(part).tobytes() for part in np.split(repeated, edge)]
    return pa.Table.from_arrays(
        [table.column(CHUNK), table.column(BUCKET), pa.array(bits, pa.binary())], names=[CHUNK, BUCKET, "_bits"]
    )


def _cut(size: int, buckets: int, keep: tuple[str, ...], whole: bool, schema: pa.Schema):
    def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs, ids, texts, words, owner, start, names = _windows(docs, size)
        distinct, first, number = np.unique(names, return_index=True, return_inverse=True)
        appear = np.argsort(first, kind="stable")
        place = np.empty_like(appear)
        place[appear] = np.arange(len(appear))
        order, met, begin = by_bucket(distinct[appear], buckets)
        bits = dict(zip(told.column(BUCKET).to_pylist(), told.column("_bits").to_pylist(), strict=True))
        earlier = np.zeros(len(distinct), dtype=bool)
        for k, bucket in enumerate(met):
            at = order[begin[k] : begin[k + 1]]
            earlier[at] = np.unpackbits(np.frombuffer(bits[int(bucket)], dtype=np.uint8), count=len(at)).astype(bool)
        repeated = earlier[place][number]
        if len(owner):
            repeated |= ids[owner[first]][number] < ids[owner]
        step = np.zeros(len(words.names) + 1, dtype=np.int32)
        hit = start[repeated]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + size, -1)
        gone = np.cumsum(step[:-1]) > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        kept = []
        for i, text in enumerate(texts):
            if whole and not removed[i]:
                kept.append(text)
                continue
            own = text.split()
            if removed[i]:
                flags = gone[words.first[i] : words.first[i + 1]]
                own = [own[j] for j in np.flatnonzero(~flags)]
            kept.append(b" ".join(own))
        return pa.Table.from_arrays(
            [
                docs.column("_id"),
                *[docs.column(f"_keep_{c}") for c in keep],
                pa.array(words.counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()),
            ],
            names=schema.names,
        )

    return lambda docs, told: and_give_back(cut, docs, told)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, keep: tuple[str, ...] = (), whole: bool = False
) -> DataFrame:
    """Remove every word covered by a window of ``size`` words that also starts in a document with a smaller id.

    Words are runs of bytes other than space and 0x09 to 0x0D. Returns one row per row: the id, the ``keep`` columns,
    n_words, n_removed and kept_text (kept words joined by one space; with ``whole``, a text that loses nothing stays as
    it is). A null or empty text has no words. Texts of
    fewer than ``size`` words lose nothing. A row without an id keeps all its words and is nobody's smaller document.
    Rows that share an id don't count as smaller than each other. Other columns are ignored; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    chunks = chunk_count(docs, text)
    dealt = in_chunks(docs, doc_id, text, chunks, keep)
    asked = dealt.groupBy(CHUNK).applyInArrow(_ask(size, chunks), _ASKED)
    told = asked.groupBy(BUCKET).applyInArrow(lambda table: and_give_back(_tell, table), _TOLD)
    fields = dealt.select(F.col("_id"), *[F.col(f"_keep_{c}") for c in keep]).schema
    out = fields.add("n_words", "long").add("n_removed", "long").add("_kept", "binary")
    cut = dealt.groupBy(CHUNK).cogroup(told.groupBy(CHUNK)).applyInArrow(_cut(size, chunks, keep, whole, to_arrow_schema(out)), out)
    return cut.select(
        F.col("_id").alias(doc_id),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        "n_words",
        "n_removed",
        F.col("_kept").cast("string").alias("kept_text"),
    )
