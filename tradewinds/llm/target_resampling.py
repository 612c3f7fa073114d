"""Importance resampling towards a target distribution, over hashed word features.

The distinct words that a piece of text repeats, each between delimiters, are made into an Aho-Corasick automaton whose
entries carry the CRC-32 and the length of their word. Scanning texts emits these payloads in order; a word that is not
in the dictionary gets its payload on the spot. The CRC of a run of words follows from the payloads of neighbours alone:
the CRC so far is moved on by the length of the next word and combined with its own. CRCs modulo the number of buckets
are the features.

Features are made once and written to the shared folder. Counts over all documents and over the target give every bucket
a gain; a document's mean gain and a draw of its own from a Gumbel distribution are its score, and the best are drawn.
The places of the drawn documents are found by sorting them in ranges, so no task has to hold them all.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tradewinds.llm.chunks import texts_of
from tradewinds.llm.scratch import written
from tradewinds.llm.words import ALPHANUMERIC, spans

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
_PIECE = 1 << 20  # bytes of text that are scanned at once
_ENTRIES, _ENTRY_BYTES = 30_000, 48  # words of a dictionary, and bytes of a word in it
_COVERED = 0.5  # share of the words of a piece below which a new dictionary is made


@cache
def _moves(power: int) -> np.ndarray:
    """What 2**power zero bytes do to a CRC-32, by each of its four bytes."""
    if power == 0:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
        out = np.empty((4, 256), dtype=np.uint32)
        out[0] = step
        for k in (1, 2, 3):
            out[k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * (k - 1))
        return out
    return _moved(_moves(power - 1), _moves(power - 1))


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & 255]
    for k in (1, 2, 3):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & 255]
    return out


def crc_joined(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings put together, from those of the parts and the length of the second."""
    out, power = left.copy(), 0
    while len(out) and (right_length >> power).any():
        has = (right_length >> power) & 1 == 1
        out[has] = _moved(_moves(power), out[has])
        power += 1
    return out ^ right


def build_automaton(text: bytes) -> ahocorasick.Automaton:
    """The words (between spaces) that ``text`` holds more than once, with CRC and length in one number."""
    automaton = ahocorasick.Automaton()
    for word, n in Counter(text.split()).most_common(_ENTRIES):
        if n > 1 and len(word) <= _ENTRY_BYTES:
            automaton.add_word(f" {word.decode('latin-1')} ", zlib.crc32(word) | len(word) << 32)
    automaton.make_automaton()
    return automaton


class Scanner:
    """Payloads of the words of texts, by a dictionary that follows what the texts hold."""

    def __init__(self) -> None:
        self.automaton: ahocorasick.Automaton | None = None

    def payloads(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRCs and lengths of the words of ``texts`` in order, and the number of words of each text. Words are runs of
        digits, letters and bytes outside ASCII, with A-Z lower-cased."""
        joined = b" " + b" ".join(texts).translate(ALPHANUMERIC) + b" "
        start, stop = spans(np.frombuffer(joined, dtype=np.uint8))
        edge = np.cumsum([1, *(len(t) + 1 for t in texts)])
        crc, known = np.zeros(len(start), dtype=np.uint32), np.zeros(len(start), dtype=bool)
        if self.automaton is None:
            self.automaton = build_automaton(joined)
        self._scan(joined, stop, crc, known)
        if known.sum() < _COVERED * len(known):
            self.automaton = build_automaton(joined)
        for k in np.flatnonzero(~known).tolist():
            crc[k] = zlib.crc32(joined[start[k] : stop[k]])
        return crc, stop - start, np.diff(np.searchsorted(start, edge))

    def _scan(self, joined: bytes, stop: np.ndarray, crc: np.ndarray, known: np.ndarray) -> None:
        if not len(self.automaton):
            return
        met = np.fromiter(chain.from_iterable(self.automaton.iter(joined.decode("latin-1"))), dtype=np.int64)
        # an entry ends with the delimiter after its word
        word = np.searchsorted(stop, met[0::2])
        crc[word] = met[1::2] & 0xFFFFFFFF
        known[word] = True


def features(scanner: Scanner, texts: list[bytes], longest: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of all runs of 1 to ``longest`` words of each text, and its number of words."""
    crc, length, counts = scanner.payloads(texts)
    edge = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(texts)), counts)
    single = (crc % buckets).astype(np.int32)
    parts, run = [[single[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]], crc
    space = np.uint32(zlib.crc32(b" "))
    for k in range(2, longest + 1):
        inside = owner[k - 1 :] == owner[: len(owner) - k + 1]
        one = np.ones(max(len(crc) - k + 1, 0), dtype=np.int64)
        run = crc_joined(run[: len(one)], np.full(len(one), space, dtype=np.uint32), one)
        run = crc_joined(run, crc[k - 1 :], length[k - 1 :])
        made, mine = (run % buckets).astype(np.int32)[inside], owner[k - 1 :][inside]
        cut = np.searchsorted(mine, np.arange(len(texts) + 1))
        parts.append([made[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
    return [np.concatenate(p) for p in zip(*parts, strict=True)], counts


def _featuring(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts = texts_of(pa.Table.from_batches([batch]))
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < _PIECE):
                    size += len(texts[end])
                    end += 1
                made, words = features(scanner, texts[at:end], longest, buckets)
                keep = batch.schema.names[1:]
                columns = [batch.column(c).slice(at, end - at) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(made, pa.list_(pa.int32())), pa.array(words)], names=[*keep, "_features", "_words"]
                )
                at = end

    return run


def with_features(docs: DataFrame, text: str, keep: dict[str, str], longest: int, buckets: int) -> DataFrame:
    """The ``keep`` columns under new names, _features and _words of every row."""
    rows = docs.select(F.col(text).cast("binary").alias("_text"), *[F.col(c).alias(name) for c, name in keep.items()])
    kinds = rows.drop("_text").schema.add("_features", ArrayType(IntegerType())).add("_words", "long")
    return rows.mapInArrow(_featuring(longest, buckets), kinds)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index("_features"))
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def bucket_counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: one array per task, added up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_lists(batch)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["_bucket", "_n"])

    counted = featured.select("_features").mapInArrow(run, "_bucket int, _n long").groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.collect():  # at most one row a bucket
        out[row["_bucket"]] = row["_n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much more often the target has a bucket, with one added to all counts; floors."""
    buckets = len(source)
    ratio = ((target + 1) * (source.sum() + buckets)) / ((source + 1) * (target.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighing(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _lists(batch)
            total = np.concatenate([[0], np.cumsum(gain[flat])])
            edge = np.concatenate([[0], np.cumsum(sizes)])
            weight = (total[edge[1:]] - total[edge[:-1]]) // np.maximum(sizes, 1)
            keep = [c for c in batch.schema.names if c != "_features"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(sizes.astype(np.int64)), pa.array(weight)],
                names=[*keep, "_n", "_weight"],
            )

    return run


def _numbering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a partition as they come."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = np.arange(at + 1, at + batch.num_rows + 1)
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(place), part, dtype=np.int32)), pa.array(place)],
            names=[*batch.schema.names, "_part", "_place"],
        )


def _ranked(scored: DataFrame, may: str, percent: int) -> DataFrame:
    """Add _rank: places by falling _score, then _id, of the best ``percent`` of the rows for which ``may`` holds."""
    by_score = scored.filter(may).groupBy("_score").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are different scores, whole numbers between fixed bounds: some ten thousand at any size
    histogram = sorted(map(tuple, by_score.collect()), reverse=True)
    drawn = percent * sum(n for _, n in histogram) // 100
    none = F.lit(None).cast("long")
    cut, above = None, 0
    for score, n in histogram:
        if above >= drawn:
            break
        cut, above = score, above + n
    if cut is None:
        return scored.withColumn("_rank", none)
    near = F.expr(may) & (F.col("_score") >= cut)
    order = [F.desc("_score"), F.asc_nulls_last("_id"), F.asc("_row")]
    sorted_rows = scored.filter(near).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = StructType([*sorted_rows.schema.fields, StructField("_part", IntegerType()), StructField("_place", LongType())])
    placed = written(sorted_rows.mapInArrow(_numbering, kinds), "drawn")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("_part").agg(F.max("_place")).collect())):  # one row a partition
        offsets.append((part, before))
        before += n
    spark = scored.sparkSession
    rank = F.col("_place") + F.col("_before")
    ranked = placed.join(F.broadcast(spark.createDataFrame(offsets, "_part int, _before long")), "_part")
    ranked = ranked.withColumn("_rank", F.when(rank <= drawn, rank)).drop("_part", "_place", "_before")
    return ranked.unionByName(scored.filter(~near).withColumn("_rank", none))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    keep: tuple[str, ...] = (),
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Draw ``percent`` percent of the documents, more likely those that read like ``target``.

    Features of a text are its runs of 1 to ``longest`` words. A bucket's gain compares its share of all features of
    ``target`` with that of all ``docs``. Returns every row: the id, the ``keep`` columns, n_features, weight (floored
    mean gain, 0 without features), score (weight plus 1000 times a Gumbel draw that depends on ``seed`` and id alone,
    floored) and rank: 1 for the highest score and so on among the drawn, null for the others. Only rows of at least
    ``least_words`` words can be drawn; equal scores go by the smaller id.

    Null and empty texts have no features and are never drawn. Rows without an id share one draw and come last among
    equal scores. Rows that repeat an id are rows of their own with the same draw, in any order among themselves. An
    empty target leaves the gains to the smoothing; a table without rows gives none. Texts are handled whole,
    one at a time in a task. Other columns have no influence, whatever their names.
    """
    names = {doc_id: "_id"} | {c: f"_keep_{c}" for c in keep if c != doc_id}
    featured = with_features(docs, text, names, longest, buckets)
    featured = written(featured.withColumn("_row", F.monotonically_increasing_id()), "features")
    wanted = bucket_counts(with_features(target, target_text, {}, longest, buckets), buckets)
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(featured, buckets), wanted))
    kinds = featured.drop("_features").schema.add("_n", "long").add("_weight", "long")

    def weigh(batches):
        return _weighing(gain.value)(batches)

    weighed = featured.mapInArrow(weigh, kinds)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.withColumn("_score", F.col("_weight") + gumbel), "scores")
    done = _ranked(scored, f"_words >= {int(least_words)}", percent)
    return done.select(
        F.col("_id").alias(doc_id),
        *[F.col(f"_keep_{c}").alias(c) for c in keep if c != doc_id],
        F.col("_n").alias("n_features"),
        F.col("_weight").alias("weight"),
        F.col("_score").alias("score"),
        F.col("_rank").alias("rank"),
    )
