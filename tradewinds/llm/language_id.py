"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier, a logistic regression over hashed byte
n-grams, predicts on which side a text stands. Decoding sums, for each codeword, the logistic losses of its bits under
the classifiers' margins, so a bit predicted with doubt counts less, and takes the codeword with the smallest sum. A
text is flagged as ambiguous if the runner-up is close.

The classifiers are fitted on about ``PER_LANGUAGE`` texts of each language, or, of very many languages, on about ``SAMPLE``
texts of all, chosen by a hash of id and text. The languages and their shares are counted over all rows, and every
language is learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewinds.llm.chunks import texts_of
from tradewinds.llm.grams import gram_counts, pieces

PER_LANGUAGE = 600
SAMPLE = 24_000  # texts to fit on, at least one of each language
SIZES, BINS = (1, 2, 3), 1024
UNKNOWN = "und"
_AMBIGUOUS = 0.8  # share of the likelihood below which a decision is flagged
_EPOCHS, _RATE, _DECAY = 200, 0.5, 1e-4
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


class Coder(NamedTuple):
    languages: list[str]
    code: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # feature x bit
    bias: np.ndarray


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: square roots of the shares of the n-grams of each size."""
    rows = []
    for piece in pieces(texts):
        parts = gram_counts(piece, SIZES, BINS, _LETTERS)
        rows.append(np.hstack([np.sqrt(c / np.maximum(c.sum(axis=1, keepdims=True), 1)) for c in parts]).astype(np.float32))
    return np.vstack(rows) if rows else np.zeros((0, len(SIZES) * BINS), dtype=np.float32)


def codewords(n: int) -> np.ndarray:
    """Codewords of -1 and 1: all ways to divide up to six languages in two, else random ones, of many draws those whose
    closest two are farthest apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1 if (k >> i) & 1 else -1 for i in range(n)] for k in range(1, 1 << n) if k & 1 and k != (1 << n) - 1]
        return np.array(columns, dtype=float).T
    random, best, apart = np.random.default_rng(0), None, -1.0
    for _ in range(100):
        code = random.choice([-1.0, 1.0], size=(n, int(np.ceil(10 * np.log2(n)))))
        near = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]).min()
        if near > apart:
            best, apart = code, near
    return best


def fit(x: np.ndarray, language: np.ndarray, languages: list[str]) -> Coder:
    """Fit the classifiers of all bits together by gradient descent with momentum; each language weighs the same."""
    code = codewords(len(languages))
    target = code[language]
    weight = (1 / np.bincount(language, minlength=len(languages))[language])[:, None] / len(languages)
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(_EPOCHS):
        pull = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * weight
        vw = 0.9 * vw - _RATE * 20 * (x.T @ pull + _DECAY * w)
        vb = 0.9 * vb - _RATE * pull.sum(axis=0)
        w, b = w + vw, b + vb
    return Coder(languages, code, w.astype(np.float32), b.astype(np.float32))


def decode(coder: Coder, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row by summed losses, and its share of the likelihood."""
    # the loss of a bit is that of one side, and the margin more on the other
    right = np.logaddexp(0, -margins)
    loss = right.sum(axis=1, keepdims=True) + margins @ ((1 - coder.code) / 2).T
    best = loss.argmin(axis=1)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return best, 1 / share.sum(axis=1)


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def _featuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(texts_of(pa.Table.from_batches([batch])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([row.tobytes() for row in x.astype(np.float16)], pa.binary())], names=["_lang", "_x"]
        )


def _predicting(coder: Coder | None, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = texts_of(pa.Table.from_batches([batch]))
                known = np.array([has_letter(t.decode("utf-8", "replace")) for t in texts], dtype=bool)
                if coder is None:
                    known[:] = False
                language, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
                if known.any():
                    x = features([t for t, k in zip(texts, known, strict=True) if k])
                    best, score[known] = decode(coder, x @ coder.weights + coder.bias)
                    language[known] = np.array(coder.languages, dtype=object)[best]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in keep],
                        pa.array(language, pa.string()),
                        pa.array(score),
                        pa.array(score < _AMBIGUOUS),
                    ],
                    names=[*keep, "_best", "_score", "_doubt"],
                )

    return run


def learn_languages(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Coder | None:
    """Fit on rows where ``learn`` holds and text and language are given."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("_lang"), F.col(text).cast("binary").alias("_text"), F.col(doc_id).alias("_id")
    )
    parts = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("languages"), F.col("_id").cast("string"), "_text"), F.lit(parts))
    rows = rows.withColumn("_draw", draw)
    counts = rows.groupBy("_lang").agg(F.count(F.lit(1)), F.min("_draw")).collect()  # one row a language
    if not counts:
        return None
    languages = sorted(r[0] for r in counts)
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(languages)))
    rates = [(r[0], max(r[2] + 1, min(parts, int(parts * each / r[1])))) for r in counts]
    rated = rows.join(F.broadcast(docs.sparkSession.createDataFrame(rates, "_lang string, _rate long")), "_lang")
    # rows that repeat are drawn together, so they count once
    drawn = rated.filter(F.col("_draw") < F.col("_rate")).select("_lang", "_text").dropDuplicates()
    sample = drawn.mapInArrow(_featuring, "_lang string, _x binary").collect()
    if not sample:
        return None
    x = np.stack([np.frombuffer(r[1], dtype=np.float16) for r in sample]).astype(np.float32)
    order = np.lexsort((*x[:, :8].T, [r[0] for r in sample]))
    number = {name: k for k, name in enumerate(languages)}
    known = np.array([number[r[0]] for r in sample])[order]
    present = np.unique(known)
    return fit(x[order], np.searchsorted(present, known), [languages[k] for k in present])


def identify_languages(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Predict the language of every whole text from the rows where ``learn`` holds.

    Returns per row: the id, the ``keep`` columns, lang_pred, score (share of the likelihood, 0 to 1) and ambiguous.
    A text that is null or has no letter is ``und`` with score 0, as are all if no row can be learned from. Rows
    without an id are predicted; rows that repeat are each predicted and learned from once. A prediction depends on its
    own text alone, of any length; the first of several codewords equally near, by name, is taken. A table without rows
    gives none.
    """
    coder = learn_languages(docs, learn, doc_id, text, lang)
    names = ["_id", *[f"_keep_{c}" for c in keep]]
    rows = docs.select(
        F.col(text).cast("binary").alias("_text"), F.col(doc_id).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep]
    )
    kinds = rows.select(names).schema.add("_best", "string").add("_score", "double").add("_doubt", "boolean")
    return rows.mapInArrow(_predicting(coder, names), kinds).select(
        F.col("_id").alias(doc_id),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        F.col("_best").alias("lang_pred"),
        F.col("_score").alias("score"),
        F.col("_doubt").alias("ambiguous"),
    )
