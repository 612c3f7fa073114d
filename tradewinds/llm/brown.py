"""Language-model scoring with Brown class-based n-grams.

Every word of the training documents gets one of ``CLASSES`` classes, in two steps:

1. Seed. The ``TOP`` most frequent words are symbols of their own, any other word stands for the moment behind one of
   ``SHAPES`` symbols by its last two bytes, and the end of a text is a symbol with a class of its own. The neighbours of
   all symbols are counted over the whole training part, and the exchange algorithm moves symbols between classes as
   long as the likelihood of the class bigrams grows.
2. Exchange of all other words. For each of them the classes before and after it are counted over the whole training
   part, combined in a chunk and added up in the bucket of its 64-bit name, and the word moves from its shape's class to
   the one where these neighbours add most to the mutual information of neighbouring classes, provided that this gains
   more than ``MOVE``, the cost of naming a class.

Transitions between classes are then counted with the final classes. A word's probability is

    P(class | class before) * P(word | class),    P(word | class) = (c + 1) / (N + V + 1) over the class

and the end is certain within its class. A word that training has not met takes the class that holds most of the words
met once with the same last two bytes. Counts and classes of words stay in their buckets, so they grow with the
corpus; what reaches the driver is bounded by TOP, SHAPES and CLASSES.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewinds.llm.chunks import BUCKET, CHUNK, CHUNK_BYTES, by_bucket, chunk_count, in_chunks, numbers, texts_of
from tradewinds.llm.components import checkpointed
from tradewinds.llm.words import LOWER, Words, mix, name_words

TOP, SHAPES, CLASSES, SWEEPS = 1024, 256, 64, 12
MOVE = math.log(CLASSES)  # what naming a word's class costs
_CELLS = 1 << 12  # cells of the neighbour counts in a row of the shuffle
_SIDES = 2 * CLASSES  # a word's neighbours: the class before, then CLASSES + the class after
_WORDS = 1 << 10  # words whose classes are weighed at once
_STATISTICS = ("_top", "_top_n")
_STATS = -1  # the chunk number of a bucket's statistics


class Seed(NamedTuple):
    top: np.ndarray  # sorted names of the frequent words
    top_number: np.ndarray  # their symbols
    home: np.ndarray  # the class of every symbol: shapes, frequent words, end
    weigh: np.ndarray  # what a neighbour (row, as in _SIDES) adds to the mutual information in a class (column)
    ends: int

    @property
    def end(self) -> int:
        return SHAPES + len(self.top)


class Classes(NamedTuple):
    total: np.ndarray  # tokens of a class without ends
    size: np.ndarray  # distinct words of a class without the end
    unknown: np.ndarray  # the class of words of a shape that training has not met

    @property
    def tokens(self) -> int:
        return int(self.total.sum())

    @property
    def distinct(self) -> int:
        return int(self.size.sum())


def shapes_of(words: Words) -> np.ndarray:
    return (mix(words.tails.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)


def symbols_of(words: Words, top: np.ndarray, top_number: np.ndarray) -> np.ndarray:
    out = shapes_of(words)
    if len(top):
        at = np.minimum(np.searchsorted(top, words.names), len(top) - 1)
        out = np.where(top[at] == words.names, top_number[at], out)
    return out


def with_ends(per_word: np.ndarray, first: np.ndarray, end) -> np.ndarray:
    """The values of the words of all texts with ``end`` after each text."""
    n = len(first) - 1
    out = np.full(len(per_word) + n, end, dtype=per_word.dtype)
    out[np.arange(len(per_word)) + np.repeat(np.arange(n), np.diff(first))] = per_word
    return out


def _packed(values: np.ndarray) -> bytes:
    """Non-negative numbers in a byte each; those from 255 on follow in eight."""
    values = values.astype(np.uint64)
    small = np.minimum(values, np.uint64(255)).astype(np.uint8)
    return len(values).to_bytes(8, "little") + small.tobytes() + values[small == 255].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    out = np.frombuffer(blob, dtype=np.uint8, count=n, offset=8).astype(np.int64)
    out[out == 255] = np.frombuffer(blob[8 + n :], dtype=np.uint64).astype(np.int64)
    return out


def _thin(names: np.ndarray) -> bytes:
    """Ascending names as steps: six bytes of each, then the upper two, which are mostly 0 and compress."""
    steps = np.diff(names, prepend=np.uint64(0))
    low = np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8)[:, :6]
    return low.tobytes() + (steps >> np.uint64(48)).astype(np.uint16).tobytes()


def _thick(blob: bytes) -> np.ndarray:
    n = len(blob) // 8
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :6] = np.frombuffer(blob, dtype=np.uint8, count=6 * n).reshape(n, 6)
    high = np.frombuffer(blob, dtype=np.uint16, offset=6 * n).astype(np.uint64) << np.uint64(48)
    return np.cumsum(steps.view(np.uint64).ravel() | high, dtype=np.uint64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of a task's texts, about CHUNK_BYTES of text at once."""
    for whole in batches:
        texts = texts_of(pa.Table.from_batches([whole]))
        edge = np.cumsum([len(t) for t in texts]) // CHUNK_BYTES
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(edge)) + 1):
            yield name_words([texts[k] for k in part], LOWER)


def _word_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _pieces(batches):
            distinct, counts = np.unique(words.names, return_counts=True)
            order, met, begin = by_bucket(distinct, buckets)
            parts = [order[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(met, pa.int32()),
                    pa.array([_thin(distinct[p]) for p in parts], pa.binary()),
                    pa.array([_packed(counts[p]) for p in parts], pa.binary()),
                ],
                names=[BUCKET, "_names", "_counts"],
            )

    return run


def _frequent(limit: int):
    def run(table: pa.Table) -> pa.Table:
        """The most frequent words of a bucket."""
        names, number = np.unique(np.concatenate([_thick(b) for b in table.column("_names").to_pylist()]), return_inverse=True)
        counts = np.concatenate([_unpacked(c) for c in table.column("_counts").to_pylist()])
        total = np.bincount(number, weights=counts, minlength=len(names)).astype(np.int64)
        top = np.lexsort((names.view(np.int64), -total))[:limit]
        return pa.Table.from_arrays(
            [pa.array([c], pa.list_(pa.int64())) for c in (names[top].view(np.int64), total[top])], names=list(_STATISTICS)
        )

    return run


def _frequent_of_task(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The most frequent words of all buckets that a task reads, in one row."""
        top = np.zeros((2, 0), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                top = np.hstack([top, np.array([row["_top"], row["_top_n"]], dtype=np.int64)])
                top = top[:, np.lexsort((top[0], -top[1]))[:limit]]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.list_(pa.int64())) for c in top], names=list(_STATISTICS))

    return run


def _neighbours(top: np.ndarray, top_number: np.ndarray):
    end = SHAPES + len(top)
    symbols = end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(-(-symbols * symbols // _CELLS) * _CELLS, dtype=np.int64)
        for words in _pieces(batches):
            line = np.append(end, with_ends(symbols_of(words, top, top_number), words.first, end))
            pair, n = np.unique(line[:-1] * symbols + line[1:], return_counts=True)
            counts[pair] += n
        blocks = counts.reshape(-1, _CELLS)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([_packed(blocks[k]) for k in used], pa.binary())], names=["_block", "_cells"]
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(_CELLS, dtype=np.int64)
    for blob in table.column("_cells"):
        total += _unpacked(blob.as_py())
    return pa.Table.from_arrays([table.column("_block").slice(0, 1), pa.array([_packed(total)], pa.binary())], names=["_block", "_cells"])


def _x_log_x(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of every symbol, given how often each follows each; the last symbol keeps a class of its own.

    Symbols start dealt out in the order of their counts. One after the other they go where the likelihood of the
    class bigrams is largest, until a sweep moves none. Ties go to the class with the smaller number.
    """
    n = len(pairs)
    weight = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-weight[:-1], kind="stable")
    home = np.empty(n, dtype=np.int64)
    home[order] = 1 + np.arange(n - 1) % (classes - 1)
    home[-1] = 0
    member = np.zeros((n, classes))
    member[np.arange(n), home] = 1
    table = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            after, before, own = pairs[w] @ member, pairs[:, w] @ member, pairs[w, w]
            old = home[w]
            after[old] -= own
            before[old] -= own
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= own
            gain = _gains(table, after, before, own)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += after
            table[:, new] += before
            table[new, new] += own
            if new != old:
                member[w, old], member[w, new] = 0, 1
                home[w] = new
                moved += 1
        if not moved:
            break
    return home


def _gains(table: np.ndarray, after: np.ndarray, before: np.ndarray, own: float) -> np.ndarray:
    """What the likelihood gains if a symbol that no class holds joins each class."""
    diagonal = np.diag(table)
    rows = (_x_log_x(table + after) - _x_log_x(table)).sum(axis=1)
    columns = (_x_log_x(table + before[:, None]) - _x_log_x(table)).sum(axis=0)
    corner = (
        _x_log_x(diagonal + after + before + own)
        - _x_log_x(diagonal + after)
        - _x_log_x(diagonal + before)
        + _x_log_x(diagonal)
    )
    out, into = table.sum(axis=1), table.sum(axis=0)
    sent, got = after.sum() + own, before.sum() + own
    return rows + columns + corner - (_x_log_x(out + sent) - _x_log_x(out)) - (_x_log_x(into + got) - _x_log_x(into))


def transitions(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed P(class | class before) and P(class), given how often each class follows each."""
    seen = table.sum(axis=0)
    overall = (seen + 1) / (seen.sum() + len(seen))
    return (table + overall) / (table.sum(axis=1, keepdims=True) + 1), overall


def seed_of(pairs: np.ndarray, top: np.ndarray, top_number: np.ndarray, ends: int) -> Seed:
    """Classes of the symbols, and what a neighbour of a class adds if a word joins each class; none joins the end."""
    home = exchange(pairs)
    member = np.zeros((len(pairs), CLASSES))
    member[np.arange(len(pairs)), home] = 1
    step, overall = transitions(member.T @ pairs @ member)
    gain = np.log(step / overall)
    weigh = np.vstack([gain, gain.T])
    weigh[:, 0] = -np.inf
    return Seed(top, top_number, home, weigh, ends)


def _seed(learning: DataFrame, buckets: int, limit: int) -> Seed:
    counted = learning.mapInArrow(_word_counts(buckets), f"{BUCKET} int, _names binary, _counts binary")
    lists = ", ".join(f"{c} array<long>" for c in _STATISTICS)
    stats = counted.groupBy(BUCKET).applyInArrow(_frequent(limit), lists).mapInArrow(_frequent_of_task(limit), lists)
    tops = (
        stats.select(F.explode(F.arrays_zip(*_STATISTICS)).alias("_t"))
        .select("_t.*")
        .orderBy(F.desc("_top_n"), "_top")
        .limit(limit)
        .collect()
    )
    names = np.array([t[0] for t in tops], dtype=np.int64).view(np.uint64)
    order = np.argsort(names)
    top, number = names[order], SHAPES + order
    symbols = SHAPES + len(top) + 1
    cells = "_block int, _cells binary"
    neighbours = learning.mapInArrow(_neighbours(top, number), cells).groupBy("_block").applyInArrow(_added, cells)
    pairs = np.zeros(-(-symbols * symbols // _CELLS) * _CELLS)
    for block, blob in neighbours.collect():
        pairs[block * _CELLS : (block + 1) * _CELLS] = _unpacked(bytes(blob))
    return seed_of(pairs[: symbols * symbols].reshape(symbols, symbols), top, number, int(learning.count()))


def _ask(buckets: int, seed: Seed):
    def ask(table: pa.Table) -> pa.Table:
        """Names, counts and shapes of a chunk's words, and the classes beside those that the seed did not class."""
        words = name_words(texts_of(table), LOWER)
        learn = np.repeat(np.array(table.column("_keep__learn").to_pylist(), dtype=bool), words.counts)
        distinct, first, number = np.unique(words.names, return_index=True, return_inverse=True)
        counts = np.bincount(number[learn], minlength=len(distinct))
        shapes = shapes_of(words)[first].astype(np.uint8)
        order, met, begin = by_bucket(distinct, buckets)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        symbol = symbols_of(words, seed.top, seed.top_number)
        line = np.append(0, with_ends(seed.home[symbol], words.first, 0))
        at = np.arange(len(number)) + words.owner
        open_ = learn & (symbol < SHAPES)
        word, at = place[number[open_]] * _SIDES, at[open_]
        beside, n = np.unique(np.concatenate([word + line[at], word + CLASSES + line[at + 2]]), return_counts=True)
        width = np.bincount(beside // _SIDES, minlength=len(distinct))
        edge = np.append(0, np.cumsum(width))[begin]
        parts = [order[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
        cells = [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        sides = (beside % _SIDES).astype(np.uint8)
        return pa.Table.from_arrays(
            [
                pa.array(met, pa.int32()),
                pa.array(np.full(len(met), table.column(CHUNK)[0].as_py()), pa.int32()),
                pa.array([_thin(distinct[p]) for p in parts], pa.binary()),
                pa.array([_packed(counts[p]) for p in parts], pa.binary()),
                pa.array([shapes[p].tobytes() for p in parts], pa.binary()),
                pa.array([_packed(width[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary()),
                pa.array([sides[c].tobytes() for c in cells], pa.binary()),
                pa.array([_packed(n[c]) for c in cells], pa.binary()),
            ],
            names=[BUCKET, CHUNK, "_names", "_counts", "_shapes", "_width", "_sides", "_beside"],
        )

    return ask


def best_classes(word: np.ndarray, side: np.ndarray, n: np.ndarray, weigh: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The class of each word in which its neighbours add most; ties to the smaller number.

    Entry i says that ``side[i]`` stands ``n[i]`` times beside ``word[i]``. A word leaves the class where it starts only
    if that gains more than naming one of the classes costs, so that words met once do not follow chance. Words without
    neighbours have class 0.
    """
    key, at = np.unique(word * _SIDES + side, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(key))
    word, side = key // _SIDES, key % _SIDES
    out = np.zeros(len(start), dtype=np.int64)
    met, begin = np.unique(word, return_index=True)
    for a in range(0, len(met), _WORDS):
        some = begin[a : a + _WORDS]
        end = begin[a + _WORDS] if a + _WORDS < len(met) else len(word)
        gain = np.add.reduceat(weigh[side[some[0] : end]] * total[some[0] : end, None], some - some[0], axis=0)
        old, row = start[met[a : a + _WORDS]], np.arange(len(some))
        new = np.argmax(gain, axis=1)
        out[met[a : a + _WORDS]] = np.where(gain[row, new] > gain[row, old] + MOVE, new, old)
    return out


def _tell(seed: Seed):
    def tell(table: pa.Table) -> pa.Table:
        """Total counts and classes in the order asked, and the bucket's statistics of classes."""
        asked = [_thick(b) for b in table.column("_names").to_pylist()]
        names, place, number = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        counts = np.concatenate([_unpacked(c) for c in table.column("_counts").to_pylist()])
        total = np.bincount(number, weights=counts, minlength=len(names)).astype(np.int64)
        shapes = np.concatenate(numbers(table.column("_shapes"), np.uint8))[place].astype(np.int64)
        width = np.concatenate([_unpacked(c) for c in table.column("_width").to_pylist()])
        sides = np.concatenate(numbers(table.column("_sides"), np.uint8)).astype(np.int64)
        n = np.concatenate([_unpacked(c) for c in table.column("_beside").to_pylist()])
        home = best_classes(np.repeat(number, width), sides, n, seed.weigh, seed.home[shapes])
        if len(seed.top):
            at = np.minimum(np.searchsorted(seed.top, names), len(seed.top) - 1)
            home = np.where(seed.top[at] == names, seed.home[seed.top_number[at]], home)
        once = np.bincount(shapes[total == 1] * CLASSES + home[total == 1], minlength=SHAPES * CLASSES)
        per_class = np.bincount(home, weights=total, minlength=CLASSES).astype(np.int64)
        stats = np.concatenate([per_class, np.bincount(home[total > 0], minlength=CLASSES), once])
        edge = np.cumsum([len(a) for a in asked])[:-1]
        return pa.Table.from_arrays(
            [
                pa.array([*table.column(CHUNK).to_pylist(), _STATS], pa.int32()),
                pa.array([*table.column(BUCKET).to_pylist(), table.column(BUCKET)[0].as_py()], pa.int32()),
                pa.array([*[_packed(part) for part in np.split(total[number], edge)], None], pa.binary()),
                pa.array([*[part.astype(np.uint8).tobytes() for part in np.split(home[number], edge)], _packed(stats)], pa.binary()),
            ],
            names=[CHUNK, BUCKET, "_totals", "_classes"],
        )

    return tell


def _sums(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The packed numbers of a task's rows added up by place."""
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for blob in batch.column(column).to_pylist():
                total = _unpacked(blob) + (total if len(total) else 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["_at", "_sum"])

    return run


def _transitions_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    for batch in batches:
        line = np.frombuffer(b"\0" + b"".join(batch.column("_line").to_pylist()), dtype=np.uint8).astype(np.int64)
        total += np.bincount(line[:-1] * CLASSES + line[1:], minlength=CLASSES * CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["_at", "_sum"])


def _added_up(parts: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for at, total in parts.groupBy("_at").agg(F.sum("_sum")).collect():
        out[at] = total
    return out


def _classes(told: DataFrame) -> Classes:
    stats = told.filter(F.col(CHUNK) == _STATS).select("_classes").mapInArrow(_sums("_classes"), "_at long, _sum long")
    total, size, once = np.split(_added_up(stats, (2 + SHAPES) * CLASSES), [CLASSES, 2 * CLASSES])
    once = once.reshape(SHAPES, CLASSES)
    # a shape without words met once goes where most of these are
    once = np.where(once.any(axis=1, keepdims=True), once, once.sum(axis=0))
    once[:, 0] = -1
    return Classes(total, size, np.argmax(once, axis=1))


def _classing(seed: Seed, classes: Classes, buckets: int, keep: tuple[str, ...], schema: pa.Schema):
    ends = seed.ends
    tokens, distinct_words = classes.tokens + ends, classes.distinct + (ends > 0)

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        words = name_words(texts_of(docs), LOWER)
        distinct, number = np.unique(words.names, return_inverse=True)
        order, met, begin = by_bucket(distinct, buckets)
        at = {bucket: k for k, bucket in enumerate(told.column(BUCKET).to_pylist())}
        totals, told_classes = told.column("_totals").to_pylist(), told.column("_classes").to_pylist()
        count, home = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        for k, bucket in enumerate(met):
            some = order[begin[k] : begin[k + 1]]
            count[some] = _unpacked(totals[at[int(bucket)]])
            home[some] = np.frombuffer(told_classes[at[int(bucket)]], dtype=np.uint8)
        n = docs.num_rows
        owner = np.repeat(np.arange(n), words.counts + 1)
        c = with_ends(count[number], words.first, ends)
        base = np.log10((c + 1) / (tokens + distinct_words + 1))
        home = np.where(count[number] > 0, home[number], classes.unknown[shapes_of(words)])
        emit = np.log10((count[number] + 1) / (classes.total + classes.size + 1)[home])
        line = with_ends(home.astype(np.uint8), words.first, 0)
        edge = np.append(0, np.cumsum(words.counts + 1))
        return pa.Table.from_arrays(
            [
                docs.column("_id"),
                *[docs.column(f"_keep_{k}") for k in keep],
                pa.array(words.counts + 1, pa.int64()),
                pa.array(np.bincount(owner, weights=c > 0, minlength=n).astype(np.int64)),
                pa.array(np.bincount(owner, weights=base, minlength=n)),
                pa.array(np.bincount(words.owner, weights=emit, minlength=n).astype(np.float64)),
                pa.array([line[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
            ],
            names=schema.names,
        )

    return run


def _scoring(step: np.ndarray, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = []
            for text in batch.column("_line").to_pylist():
                line = np.frombuffer(b"\0" + text, dtype=np.uint8)
                steps.append(step[line[:-1], line[1:]].sum())
            score = np.array(batch.column("_emit").to_pylist(), dtype=np.float64) + np.array(steps, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(score)], names=[*columns, "_score"])

    return run


def score_texts(
    docs: DataFrame, learn, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), frequent: int = TOP
) -> DataFrame:
    """Log10 probabilities of all texts under a class-based model and a unigram model of the rows where ``learn`` (a
    column expression) holds.

    Tokens are the lower-cased (A-Z) words, split at space and 0x09 to 0x0D, and one end. Returns per row: the id, the
    ``keep`` columns, n_tokens, n_known (tokens met in training), train_tokens, base_score (sum of
    log10((c + 1) / (N + V + 1))) and score. ``frequent`` is the number of words that the seed classes one by one.
    Null and empty texts are one end token. Rows for which ``learn`` is null are scored, not learned from; rows without
    an id likewise count by ``learn``; repeated rows are learned from and scored as often as they stand. Ties between
    frequent words go to the smaller name, between classes to the smaller number. Without a training row every word is
    unknown; an empty table gives no rows. A text of any length is scored whole, in one task. Words with equal 64-bit
    names would be counted together (chance 2**-64 a pair).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    chunks = chunk_count(docs, text)
    marked = docs.withColumn("_learn", F.coalesce(learn, F.lit(False)))
    columns = (*keep, "_learn")
    dealt = in_chunks(marked, doc_id, text, chunks, columns)
    seed = _seed(marked.filter("_learn").select(F.col(text).cast("binary").alias("_text")), chunks, frequent)
    blobs = ", ".join(f"{c} binary" for c in ("_names", "_counts", "_shapes", "_width", "_sides", "_beside"))
    asked = dealt.groupBy(CHUNK).applyInArrow(_ask(chunks, seed), f"{BUCKET} int, {CHUNK} int, {blobs}")
    told = checkpointed(asked.groupBy(BUCKET).applyInArrow(_tell(seed), f"{CHUNK} int, {BUCKET} int, _totals binary, _classes binary"))
    classes = _classes(told)
    kinds = dealt.select("_id", *[f"_keep_{c}" for c in columns]).schema
    kinds = kinds.add("_n", "long").add("_known", "long").add("_base", "double").add("_emit", "double").add("_line", "binary")
    classed = checkpointed(
        dealt.groupBy(CHUNK)
        .cogroup(told.filter(F.col(CHUNK) != _STATS).groupBy(CHUNK))
        .applyInArrow(_classing(seed, classes, chunks, columns, to_arrow_schema(kinds)), kinds)
    )
    follow = classed.filter("_keep__learn").select("_line").mapInArrow(_transitions_of_task, "_at long, _sum long")
    step, _ = transitions(_added_up(follow, CLASSES * CLASSES).reshape(CLASSES, CLASSES).astype(np.float64))
    kept = ["_id", *[f"_keep_{c}" for c in keep], "_n", "_known", "_base"]
    final = classed.select(*kept).schema.add("_score", "double")
    scored = classed.select(*kept, "_emit", "_line").mapInArrow(_scoring(np.log10(step), kept), final)
    return scored.select(
        F.col("_id").alias(doc_id),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        F.col("_n").alias("n_tokens"),
        F.col("_known").alias("n_known"),
        F.lit(classes.tokens + seed.ends).cast("long").alias("train_tokens"),
        F.col("_base").alias("base_score"),
        F.col("_score").alias("score"),
    )
