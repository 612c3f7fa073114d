"""Ranked lexical search: accumulators of short lists, then document-at-a-time skipping over long lists.

The index holds, for every document, the words of the queries that occur in it and how often. It is written once for all
queries of a block; a search task turns segments of it into lists by word. In a segment, the short lists of a query are
summed term by term; the sums are one more list, whose largest entry in each block of documents is known. This list and
the long ones go document by document side by side: a block is skipped if its largest entries together stay below the
worst of the best found so far, then a document by its own sum and what the long lists can add at most; only what is
left meets its entries in the long lists, which stops again as soon as the rest can't lift it.

Queries go to the tasks in blocks of at most ``BLOCK_BYTES`` bytes of text, one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewinds.llm.chunks import texts_of
from tradewinds.llm.scratch import written
from tradewinds.llm.words import ALPHANUMERIC, Words, name_words

TOP = 10
BLOCK_BYTES = 2 << 20
_PIECE = 2 << 20  # bytes of text whose words are looked up at once
_SEGMENT = 4096  # documents of a segment
_ENTRIES = 1 << 20  # entries of a segment, but one document at least
_STEP = 64  # documents that are skipped together
_LONG = 16  # a list is long if it holds more than one in so many documents of the segment
_TOGETHER = 256  # queries that are searched for side by side
_SCALE = 1_000_000_000

INDEX = "_id long, _length long, _terms array<int>, _tf array<int>"


class Queries(NamedTuple):
    """Terms of the queries of a block: names of all words, ascending, and the term numbers of query i in
    ``terms[first[i]:first[i + 1]]``."""

    vocabulary: np.ndarray
    first: np.ndarray
    terms: np.ndarray


class Segment(NamedTuple):
    """Documents by number, and the list of term ``terms[k]`` in ``docs[begin[k]:begin[k + 1]]``, ``tf`` alike."""

    ids: np.ndarray
    missing: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    begin: np.ndarray
    docs: np.ndarray
    tf: np.ndarray


class Statistics(NamedTuple):
    """Documents with a word, all their words, and the weight of each term."""

    documents: int
    words: int
    weights: np.ndarray


class Found(NamedTuple):
    """Documents found for queries, in order of query, score (falling), missing id, id."""

    query: np.ndarray
    score: np.ndarray
    missing: np.ndarray
    ids: np.ndarray


NOTHING = Found(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64)))


def build_queries(texts: list[bytes]) -> Queries:
    words = name_words(texts, ALPHANUMERIC)
    vocabulary, number = np.unique(words.names, return_inverse=True)
    pairs = np.unique(words.owner * max(len(vocabulary), 1) + number)
    owner, terms = np.divmod(pairs, max(len(vocabulary), 1))
    return Queries(vocabulary, np.searchsorted(owner, np.arange(len(texts) + 1)), terms)


def entries(words: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of the words that are in the vocabulary, in order of document, then term."""
    at = np.minimum(np.searchsorted(vocabulary, words.names), max(len(vocabulary) - 1, 0))
    known = vocabulary[at] == words.names if len(vocabulary) else np.zeros(len(words.names), dtype=bool)
    pairs, tf = np.unique(words.owner[known] * max(len(vocabulary), 1) + at[known], return_counts=True)
    doc, term = np.divmod(pairs, max(len(vocabulary), 1))
    return doc, term, tf


def _lists(flat: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _indexing(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        for batch in batches:
            texts = texts_of(pa.Table.from_batches([batch]))
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < _PIECE):
                    size += len(texts[end])
                    end += 1
                words = name_words(texts[at:end], ALPHANUMERIC)
                doc, term, tf = entries(words, vocabulary)
                edge = np.searchsorted(doc, np.arange(end - at + 1))
                ids = batch.column(batch.schema.get_field_index("_id")).slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(words.counts), _lists(term, edge), _lists(tf, edge)], names=["_id", "_length", "_terms", "_tf"]
                )
                at = end

    return run


def statistics(index: DataFrame, terms: int) -> Statistics:
    """What the weights need; at most one row a term of the queries goes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["_term", "_df"])

    n, words = index.agg(F.count_if(F.col("_length") > 0), F.sum("_length")).first()
    held = np.zeros(terms, dtype=np.int64)
    for term, df in index.select("_terms").mapInArrow(count, "_term int, _df long").groupBy("_term").agg(F.sum("_df")).collect():
        held[term] = df
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) if df else 0 for df in held.tolist()]
    return Statistics(n, words or 0, np.array(weights, dtype=np.int64))


def impacts(segment: Segment, of: Statistics) -> np.ndarray:
    """What a unit of weight brings, for every entry of every list."""
    m = 10 + (90 * segment.lengths * of.documents) // max(of.words, 1)
    return (_SCALE * segment.tf) // (1000 * segment.tf + 8 * m[segment.docs])


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after the other, and the range of each."""
    n = end - begin
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n), owner


def _thresholds(best: Found, first: int, many: int, top: int) -> np.ndarray:
    """The score of the last of the ``top`` best of each query; 1 if there are fewer, as a score must be above 0."""
    out = np.ones(many, dtype=np.int64)
    a, b = np.searchsorted(best.query, [first, first + many])
    query, begin, n = np.unique(best.query[a:b], return_index=True, return_counts=True)
    full = n >= top
    out[query[full] - first] = best.score[a + begin[full] + top - 1]
    return out


def search_segment(segment: Segment, queries: Queries, of: Statistics, best: Found, top: int = TOP) -> Found:
    """The best documents of ``best`` and of a segment together."""
    impact = impacts(segment, of)
    if not len(impact):
        return best
    size = np.diff(segment.begin)
    # lists by their number in the segment; -1 where the segment has no list
    place = np.full(len(of.weights), -1, dtype=np.int64)
    place[segment.terms] = np.arange(len(segment.terms))
    long = size * _LONG > len(segment.ids)
    steps = -(-len(segment.ids) // _STEP)
    # long lists as rows over all documents, and their largest entries
    row = np.cumsum(long) - 1
    at, owner = _spread(segment.begin[:-1][long], segment.begin[1:][long])
    rows = np.zeros((int(long.sum()), steps * _STEP), dtype=np.int64)
    rows[owner, segment.docs[at]] = impact[at]
    step_most = rows.reshape(len(rows), steps, _STEP).max(axis=2, initial=0)
    for first in range(0, len(queries.first) - 1, _TOGETHER):
        many = min(_TOGETHER, len(queries.first) - 1 - first)
        term, query = _spread(queries.first[first : first + many], queries.first[first + 1 : first + many + 1])
        term = queries.terms[term]
        use = (place[term] >= 0) & (of.weights[term] > 0)
        term, query = term[use], query[use]
        weight, of_list = of.weights[term], place[term]
        short = ~long[of_list]
        # short lists: sums over all of them
        at, owner = _spread(segment.begin[of_list[short]], segment.begin[of_list[short] + 1])
        sums = np.zeros((many, steps * _STEP), dtype=np.int64)
        np.add.at(sums, (query[short][owner], segment.docs[at]), weight[short][owner] * impact[at])
        query, weight, list_row = query[~short], weight[~short], row[of_list[~short]]
        # long lists of a query stand side by side, the one that can add most first
        order = np.lexsort((-weight * step_most[list_row].max(axis=1, initial=0), query))
        query, weight, list_row = query[order], weight[order], list_row[order]
        begin = np.searchsorted(query, np.arange(many + 1))
        least = _thresholds(best, first, many, top)
        got = _document_at_a_time(sums, rows, step_most, begin, weight, list_row, least)
        fits = got[1] < len(segment.ids)
        asked, doc, score = (g[fits] for g in got)
        best = _merged(best, Found(asked + first, score, segment.missing[doc], segment.ids[doc]), top)
    return best


def _document_at_a_time(sums, rows, step_most, begin, weight, list_row, least):
    """(query, document, score) of all documents that reach ``least`` of their query."""
    many, steps = len(sums), step_most.shape[1]
    step_sums = sums.reshape(many, steps, _STEP).max(axis=2, initial=0)
    can_add = np.zeros((many, steps), dtype=np.int64)
    np.add.at(can_add, np.repeat(np.arange(many), np.diff(begin)), weight[:, None] * step_most[list_row])
    asked, step = np.nonzero(step_sums + can_add >= least[:, None])
    doc = (step[:, None] * _STEP + np.arange(_STEP)).ravel()
    asked, rest = np.repeat(asked, _STEP), np.repeat(can_add[asked, step], _STEP)
    score, k = sums[asked, doc], 0
    done = []
    while len(asked):
        stay = score + rest >= least[asked]
        asked, doc, score, rest = asked[stay], doc[stay], score[stay], rest[stay]
        over = begin[asked] + k >= begin[asked + 1]
        done.append((asked[over], doc[over], score[over]))
        asked, doc, score, rest = asked[~over], doc[~over], score[~over], rest[~over]
        at = begin[asked] + k
        w, r = weight[at], list_row[at]
        score = score + w * rows[r, doc]
        rest = rest - w * step_most[r, doc // _STEP]
        k += 1
    if not done:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(d) for d in zip(*done, strict=True))


def _merged(best: Found, more: Found, top: int) -> Found:
    if not len(more.query):
        return best
    both = Found(*(np.concatenate(c) for c in zip(best, more, strict=True)))
    both = Found(*(c[np.lexsort((both.ids, both.missing, -both.score, both.query))] for c in both))
    start = np.searchsorted(both.query, both.query)
    return Found(*(c[np.arange(len(start)) - start < top] for c in both))


def _searching(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, of = shared.value
        best = NOTHING
        for batch in batches:
            for segment in segments(batch):
                best = search_segment(segment, queries, of, best, top)
        ids = pa.array(best.ids, pa.int64(), mask=best.missing)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), ids, pa.array(best.score)], names=["_query", "_id", "_score"])

    return run


def segments(batch: pa.RecordBatch) -> Iterator[Segment]:
    """The rows of the index in segments, their entries in lists by term."""
    ids, lengths, terms, tf = (batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_length", "_terms", "_tf"))
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    known = ids.fill_null(0).to_numpy(zero_copy_only=False)
    lengths = lengths.to_numpy(zero_copy_only=False)
    edge = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))])
    terms, tf = terms.flatten().to_numpy(zero_copy_only=False), tf.flatten().to_numpy(zero_copy_only=False)
    at = 0
    while at < len(known):
        end = max(at + 1, min(at + _SEGMENT, int(np.searchsorted(edge, edge[at] + _ENTRIES, side="right")) - 1))
        here = slice(edge[at], edge[end])
        order = np.argsort(terms[here], kind="stable")
        doc = np.repeat(np.arange(end - at), np.diff(edge[at : end + 1]))
        met, begin = np.unique(terms[here][order], return_index=True)
        yield Segment(
            known[at:end], missing[at:end], lengths[at:end], met, np.append(begin, len(order)), doc[order], tf[here][order].astype(np.int64)
        )
        at = end


def _search_block(docs: DataFrame, texts: list[bytes], top: int) -> DataFrame:
    spark = docs.sparkSession
    queries = build_queries(texts)
    shared = spark.sparkContext.broadcast(queries)
    index = written(docs.mapInArrow(_indexing(shared), INDEX), "index")
    asked = spark.sparkContext.broadcast((queries, statistics(index, len(queries.vocabulary))))
    return index.mapInArrow(_searching(asked, top), "_query long, _id long, _score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
) -> DataFrame:
    """Rank all documents for each item and return the best ``top`` of each: item_id, rank (from 1), doc_id, score.

    Terms are runs of digits, letters and characters outside ASCII, with A-Z lower-cased. A term that df of N documents
    with terms hold weighs floor(1000 * ln((2N + 2) / (2df + 1))); a document's score adds, for each term of the item
    that it holds tf times, the weight times 10**9 tf div (1000 tf + 8 m), where m is 10 + (90 n N div L), n its
    terms and L those of all documents. Only scores above 0 count; equal ones go by the smaller id.

    Null and empty texts have no terms: such documents are not counted and never found, such items find nothing. Every
    row is a document or an item of its own, also where rows or ids repeat. Documents without an id take part and come
    last among equal scores; items without an id keep that. Ids of documents must fit a long. Empty tables give no rows.
    Texts are handled whole. Words are compared by 64-bit names, see ``words``. Other columns have no influence.
    """
    spark = docs.sparkSession
    asked = items.select(
        F.monotonically_increasing_id().alias("_row"), F.col(item_id).alias("_item"), F.col(item_text).cast("binary").alias("_text")
    ).filter(F.octet_length("_text") > 0)
    asked = written(asked, "queries")
    total = asked.agg(F.sum(F.octet_length("_text") + 32)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    rows = docs.select(F.col(text).cast("binary").alias("_text"), F.col(doc_id).cast("long").alias("_id"))
    found = None
    for k in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == k).sort("_row").collect()
        block = _search_block(rows, [bytes(r["_text"]) for r in part], top)
        names = spark.createDataFrame([(i, r["_row"]) for i, r in enumerate(part)], "_query long, _row long")
        block = block.join(F.broadcast(names), "_query").select("_row", "_id", "_score")
        block = written(block, "found") if blocks > 1 else block
        found = block if found is None else found.union(block)
    # the best of some tasks first, so that no item has to sort what all tasks found
    order = [F.desc("_score"), F.asc_nulls_last("_id")]
    some = Window.partitionBy("_row", F.pmod(F.xxhash64("_id"), F.lit(64))).orderBy(*order)
    best = found.withColumn("_place", F.row_number().over(some)).filter(F.col("_place") <= top).drop("_place")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("_row").orderBy(*order))).filter(F.col("rank") <= top)
    named = best.join(F.broadcast(asked.select("_row", "_item")) if blocks == 1 else asked.select("_row", "_item"), "_row")
    return named.select(F.col("_item").alias(item_id), "rank", F.col("_id").alias(doc_id), F.col("_score").alias("score"))
