"""Quality classification with supervised subword embeddings.

Words, pairs of neighbouring words and byte n-grams are hashed to rows of a table of vectors. All pairs of a word
and itself share a row, as repeating is what they have in common. The vectors of a document are averaged and a softmax
layer gives the probability of each label. Table and layer are learned together by stochastic gradient descent on about
``PER_LABEL`` documents of each label, chosen by a hash of the id, and by one of the text where ids repeat; a document weighs
as many as it stands for, so the labels keep the shares that they have in all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewinds.llm.chunks import give_back, texts_of
from tradewinds.llm.grams import gram_counts, pieces, word_counts

PER_LABEL = 1000
WORD_BINS, PAIR_BINS, GRAM_BINS, SIZES, WIDTH = 4096, 1024, 2048, (2, 3), 16
_EPOCHS, _BATCH, _RATE = 12, 16, 2.0
BINS = WORD_BINS + PAIR_BINS + GRAM_BINS * len(SIZES)


class Embedding(NamedTuple):
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray


def shares(texts: list[bytes]) -> np.ndarray:
    """One row per text: the share of each feature among those of its kind."""
    rows = [np.zeros((0, BINS), dtype=np.float32)]
    for piece in pieces(texts):
        parts = [*word_counts(piece, WORD_BINS, PAIR_BINS), *gram_counts(piece, SIZES, GRAM_BINS)]
        rows.append(np.hstack([c / np.maximum(c.sum(axis=1, keepdims=True), 1) / len(parts) for c in parts]).astype(np.float32))
    return np.vstack(rows)


def fit(x: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray) -> Embedding:
    """Stochastic gradient descent over sparse rows (places, shares)."""
    random = np.random.default_rng(0)
    vectors = random.uniform(-1, 1, (BINS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    weight = weight / weight.mean()
    steps, done = _EPOCHS * -(-len(x) // _BATCH), 0
    for _ in range(_EPOCHS):
        order = random.permutation(len(x))
        for at in range(0, len(x), _BATCH):
            rate = np.float32(_RATE * (1 - done / steps))
            done += 1
            own = order[at : at + _BATCH]
            places = np.concatenate([x[i][0] for i in own])
            values = np.concatenate([x[i][1] for i in own])
            row = np.repeat(np.arange(len(own)), [len(x[i][0]) for i in own])
            used, place = np.unique(places, return_inverse=True)
            dense = np.zeros((len(own), len(used)), dtype=np.float32)
            dense[row, place] = values
            mean = dense @ vectors[used]
            p = _softmax(mean @ layer + bias)
            p[np.arange(len(own)), label[own]] -= 1
            p *= (weight[own] / len(own))[:, None].astype(np.float32)
            back = p @ layer.T
            layer -= rate * (mean.T @ p)
            bias -= rate * p.sum(axis=0)
            # a share is small, so its vector gets a longer step
            vectors[used] -= rate * 20 * (dense.T @ back)
    return Embedding(vectors, layer, bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probability(model: Embedding, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1."""
    out = [_softmax(shares(piece) @ model.vectors @ model.layer + model.bias)[:, 1] for piece in pieces(texts)]
    return np.concatenate(out).astype(float) if out else np.zeros(0)


def _featuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, values = [], []
        for piece in pieces(texts_of(pa.Table.from_batches([batch]))):
            for row in shares(piece):
                at = np.flatnonzero(row)
                places.append(at.astype(np.uint16).tobytes())
                values.append(row[at].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
            names=["_label", "_weight", "_places", "_values"],
        )


def _scoring(model: Embedding | None, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = texts_of(pa.Table.from_batches([batch]))
                score = probability(model, texts) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score, pa.float64())], names=[*keep, "_score"])
        give_back()

    return run


def learn_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> Embedding | None:
    """Fit on the labelled rows where ``learn``, a condition on the id column of ``labels``, holds."""
    rows = labels.filter(learn & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    if not counts:
        return None
    parts = 1 << 20
    rate = {k: min(parts, int(parts * PER_LABEL / n) + 1) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("_id").cast("string")), F.lit(parts))
    drawn = rows.filter(draw < F.when(F.col("_label") == 1, rate.get(1, 0)).otherwise(rate.get(0, 0)))
    stands_for = F.when(F.col("_label") == 1, parts / rate.get(1, parts)).otherwise(parts / rate.get(0, parts))
    # ids are drawn as a whole: about PER_LABEL of each label, each once, so a broadcast is bounded
    drawn = drawn.withColumn("_weight", stands_for.cast("double")).dropDuplicates()
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text"))
    known = texts.join(F.broadcast(drawn), "_id")
    # one id may have any number of rows
    found = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    thin = {k: min(parts, int(parts * 2 * PER_LABEL / n) + 1) for k, n in found.items()}
    share = F.when(F.col("_label") == 1, thin.get(1, parts)).otherwise(thin.get(0, parts))
    known = known.filter(F.pmod(F.xxhash64(F.lit("texts"), "_text"), F.lit(parts)) < share).dropDuplicates()
    known = known.withColumn("_weight", F.col("_weight") * parts / share)
    kinds = "_label int, _weight double, _places binary, _values binary"
    sample = known.select("_label", "_weight", "_text").mapInArrow(_featuring, kinds).collect()
    sample.sort(key=lambda r: (r[0], bytes(r[2]), bytes(r[3])))
    if not sample:
        return None
    x = [(np.frombuffer(r[2], dtype=np.uint16).astype(np.int64), np.frombuffer(r[3], dtype=np.float32)) for r in sample]
    return fit(x, np.array([r[0] for r in sample]), np.array([r[1] for r in sample]))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Score every whole text for quality, learning from the labels where ``learn`` holds.

    Returns per row: the id, the ``keep`` columns and score, the probability of label 1. A null text is scored as an
    empty one. Without a label every score is 0.5. Labels other than 0 and 1 and labels of unknown documents are not
    learned from; a document labelled or listed repeatedly with the same label and text counts once. Rows without an id
    are scored, and each of several equal rows. A score depends on its own text alone, of any length. A table without
    rows gives none.
    """
    model = learn_quality(docs, labels, learn, doc_id, text, label)
    names = ["_id", *[f"_keep_{c}" for c in keep]]
    rows = docs.select(
        F.col(text).cast("binary").alias("_text"), F.col(doc_id).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep]
    )
    kinds = rows.select(names).schema.add("_score", "double")
    return rows.mapInArrow(_scoring(model, names), kinds).select(
        F.col("_id").alias(doc_id), *[F.col(f"_keep_{c}").alias(c) for c in keep], F.col("_score").alias("score")
    )
