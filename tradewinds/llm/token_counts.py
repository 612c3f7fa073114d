"""Token counts by a two-tier lookup of pre-token lengths, without shuffling pre-tokens.

The splitting pattern of a byte-level vocabulary divides a text into pre-tokens, which are encoded apart from each
other, so the length of a text in tokens is the sum of theirs. Lengths of frequent pre-tokens come in one small hash
table that every task gets; a pre-token that is not there is looked for among those that the worker has met lately,
and encoded by the vocabulary's own model if it is not there either.

What is frequent is found in all documents: each task counts white-space words in bounded memory and hands on its most
frequent ones; those that make up a given share of all words are looked up, which at most as many words as the share
goes into one can do. The table only saves work, so an inexact count there changes no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradewinds.llm.bpe import byte_letters
from tradewinds.llm.chunks import texts_of
from tradewinds.llm.scratch import written

LIMIT = 1024
SHARE = 2.0**-17  # of all words, from which on a word's pre-tokens are in the table: 131,072 words at most
LONGEST = 48  # characters of a word or pre-token that is remembered
_COUNTED, _KEPT = 300_000, 60_000  # different words a task counts before it lets the rare ones go, and those that stay
_HANDED_ON = 16_384  # words that a task hands on
_REMEMBERED = 150_000  # pre-tokens of a generation that a worker remembers; it keeps the last two
_WHOLE = 1 << 20  # characters of a text up to which its pre-tokens are listed at once


class Vocabulary:
    """The model of a byte-level vocabulary of the tokenizers library, asked for one pre-token at a time."""

    def __init__(self, path: str, pattern: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = {b: ord(letter) for letter, b in byte_letters().items()}
        added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = regex.compile(pattern)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def encoded_length(self, piece: str) -> int:
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def length(self, piece: str) -> int:
        """Tokens of a pre-token, from the worker's memory if it is there."""
        if len(piece) > LONGEST:
            return self.encoded_length(piece)
        n = self.young.get(piece)
        if n is None:
            n = self.old.get(piece) or self.encoded_length(piece)
            if len(self.young) >= _REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[piece] = n
        return n

    def pieces(self, text: str) -> Iterable[str]:
        if len(text) <= _WHOLE:
            return self.split.findall(text)
        return (found.group() for found in self.split.finditer(text))

    def is_special(self, text: str) -> bool:
        return self.special is not None and self.special.search(text) is not None


class Lengths(dict):
    """Lengths by pre-token: the shared table, then what ``vocabulary`` says."""

    def __init__(self, table: dict[str, int], vocabulary: Vocabulary):
        super().__init__(table)
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> int:
        return self.vocabulary.length(piece)

    def of_text(self, text: str) -> int:
        """Tokens of a whole text; the library itself counts one that holds the string of a special token."""
        if self.vocabulary.is_special(text):
            return len(self.vocabulary.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.vocabulary.pieces(text)))


@cache
def load(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _strings(batch: pa.RecordBatch) -> Iterator[str]:
    for text in texts_of(pa.Table.from_batches([batch])):
        yield text.decode("utf-8", "replace")


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent words of a task with their counts, and under null the number of all its words."""
    counts: Counter[str] = Counter()
    total = 0
    for batch in batches:
        for text in _strings(batch):
            words = text.split()
            total += len(words)
            counts.update(words)
            if len(counts) > _COUNTED:
                counts = Counter(dict(counts.most_common(_KEPT)))
    best = [(word, n) for word, n in counts.most_common() if len(word) < LONGEST][:_HANDED_ON]
    words, numbers = zip((None, total), *best, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], names=["_word", "_n"])


def frequent_words(docs: DataFrame, text: str = "text", share: float = SHARE) -> list[str]:
    """The white-space words, shorter than ``LONGEST`` characters, that make up ``share`` of all words or more.

    A task hands on a bounded number of words, whatever it reads, and no more than 1 / ``share`` words reach the driver.
    """
    met = docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(_counting, "_word string, _n long")
    counts = written(met.groupBy("_word").agg(F.sum("_n").alias("_n")), "words")
    total = counts.filter("_word is null").first()
    least = share * total["_n"] if total else 0
    return [r["_word"] for r in counts.filter(F.col("_word").isNotNull() & (F.col("_n") >= least)).collect()]


def length_table(words: Iterable[str], vocabulary: Vocabulary) -> dict[str, int]:
    """Lengths of the pre-tokens of ``words``, each taken to follow a space."""
    pieces = {piece for word in words for piece in vocabulary.pieces(" " + word)}
    return {piece: vocabulary.encoded_length(piece) for piece in sorted(pieces)}


def _summing(shared, path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(shared.value, load(path, pattern))
        for batch in batches:
            n = pa.array([lengths.of_text(text) for text in _strings(batch)], pa.int64())
            keep = batch.schema.names[1:]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], n], names=[*keep, "_n"])

    return run


def count_tokens(
    docs: DataFrame,
    path: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    limit: int = LIMIT,
    share: float = SHARE,
) -> DataFrame:
    """Count the tokens of every whole text by the byte-level vocabulary at ``path`` (on every machine).

    Counts are those of the tokenizers library without added special tokens, truncation and padding; the string of a
    special token in a text is one token, as the library has it by default. Returns per row: the id, the ``keep``
    columns, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    A null or empty text has no bytes and tokens; bytes that are no UTF-8 count as replacement characters. A text is
    handled in one task, of any length, and never cut. Rows are looked at one by one, so rows without an id, equal
    texts and repeated rows stay as they are; a table without rows gives none. Other columns have no influence,
    whatever their names.
    """
    lengths = length_table(frequent_words(docs, text, share), load(path, pattern))
    shared = docs.sparkSession.sparkContext.broadcast(lengths)
    rows = docs.select(
        F.col(text).cast("binary").alias("_text"),
        F.col(doc_id).alias("_id"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
        F.coalesce(F.octet_length(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("_bytes"),
    )
    done = rows.mapInArrow(_summing(shared, path, pattern), rows.drop("_text").schema.add("_n", "long"))
    return done.select(
        F.col("_id").alias(doc_id),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        F.col("_bytes").alias("n_bytes"),
        F.col("_n").alias("n_tokens"),
        (F.col("_n") > limit).alias("over_limit"),
    )
