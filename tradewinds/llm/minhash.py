"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketching: in round r every shingle of a set gets a bin and a value from a hash of (shingle, r); a bin keeps its
smallest value and values of earlier rounds are smaller. After the first round that leaves no bin empty the set is
done; from round ``COORDINATES`` on round r serves bin r - COORDINATES alone, so twice that many rounds always
suffice. Two sets agree in a coordinate with the probability of their similarity, and the whole costs about one pass
over a large set. ``ROWS`` coordinates make a band; a pair of similarity 0.8 shares no band with a chance of 3e-6.

Verification: equal sets are one class and only classes go on. Of the classes that share a band, one (that with the
most company over all bands) is the hub, and every member is compared with it on the full sets. What is left are
pairs of classes in different components of which at least one is not in the hub's. They are compared too, unless
what is known from the hub h rules a link out: |x & y| <= min(|x & h|, |y & h|) + |(x - h) & (y - h)|.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewinds.llm.chunks import give_back, texts_of
from tradewinds.llm.components import checkpointed, components
from tradewinds.llm.words import LOWER, join_names, mix, name_words, seeded, sequences

BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct names of the shingles of each text."""
    names, owner = sequences(name_words(texts, LOWER), width, short=True)
    order = np.argsort(owner, kind="stable")
    names, edge = names[order], np.searchsorted(owner[order], np.arange(1, len(texts)))
    return [np.unique(part) for part in np.split(names, edge)]


def sketch(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of ``coordinates`` values for each set, none of which may be empty."""
    made = np.full(len(sets) * coordinates, _EMPTY, dtype=np.uint64)
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for r in range(2 * coordinates):
        h = seeded(items, r)
        if r < coordinates:
            at = ((h >> np.uint64(32)) * np.uint64(coordinates)) >> np.uint64(32)
        else:
            at = np.uint64(r - coordinates)
        np.minimum.at(made, owner * coordinates + at.astype(np.int64), (np.uint64(r) << np.uint64(32)) | (h & _LOW))
        lacking = (made.reshape(len(sets), coordinates) == _EMPTY).any(axis=1)
        if not lacking.any():
            break
        stay = lacking[owner]
        items, owner = items[stay], owner[stay]
    return made.reshape(len(sets), coordinates)


def _bands(sketches: np.ndarray) -> np.ndarray:
    groups = sketches.reshape(len(sketches), BANDS, ROWS)
    keys = np.broadcast_to(seeded(np.arange(BANDS, dtype=np.uint64), 7), (len(sketches), BANDS)).copy()
    for k in range(ROWS):
        keys = join_names(keys, groups[:, :, k])
    return keys.view(np.int64)


def _sketching(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                table = pa.Table.from_batches([batch])
                sets = shingle_sets(texts_of(table), width)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                some = np.flatnonzero(sizes)
                marks = [mix(np.array([seeded(s, k).sum() for k in (1, 2)] + [len(s)], dtype=np.uint64)).tobytes() if len(s) else None for s in sets]
                keys = [None] * len(sets)
                if len(some):
                    for i, row in zip(some, _bands(sketch([sets[i] for i in some])), strict=True):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["_id", "_size", "_set", "_keys"],
                )
        give_back()

    return run


def _comparing(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, np.zeros(0, dtype=np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                table = pa.Table.from_batches([batch])
                mine, theirs = shingle_sets(texts_of(table, "_a_text"), width), texts_of(table, "_b_text")
                both, size_b, own = [], [], []
                for a, text in zip(mine, theirs, strict=True):
                    if text != last_text:
                        last_text, last = text, shingle_sets([text], width)[0]
                    left = np.setdiff1d(a, last, assume_unique=True)
                    both.append(len(a) - len(left))
                    size_b.append(len(last))
                    own.append(left.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([len(a) for a in mine], pa.int64()),
                        pa.array(size_b, pa.int64()),
                        pa.array(both, pa.int64()),
                        pa.array(own, pa.list_(pa.int64())),
                    ],
                    names=["_a", "_b", "_a_size", "_b_size", "_both", "_own"],
                )
        give_back()

    return run


def _compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The full sets of each pair (_a, _b) compared: sizes, intersection, and what only _a has."""
    a = texts.select(F.col("_id").alias("_a"), F.col("_text").alias("_a_text"))
    b = texts.select(F.col("_id").alias("_b"), F.col("_text").alias("_b_text"))
    rows = pairs.join(a, "_a").join(b, "_b").select("_a", "_b", "_a_text", "_b_text")
    kinds = "_a long, _b long, _a_size long, _b_size long, _both long, _own array<long>"
    return rows.mapInArrow(_comparing(width), kinds)


def near_duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80
) -> DataFrame:
    """Link documents whose sets of ``width``-word shingles have 100 * intersection >= percent * union.

    Words are lower-cased (A-Z) and split at space and 0x09 to 0x0D; fewer words than ``width`` make one shingle.
    Returns per row: the id, n_shingles, component_id (the smallest id reachable) and kept (id = component_id).
    Null and empty texts have no shingle and are linked with nothing; rows without an id have no component and are
    kept. Rows that share an id are one document. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    sketched = checkpointed(texts.select("_id", "_text").mapInArrow(_sketching(width), "_id long, _size long, _set binary, _keys array<long>"))
    classes = checkpointed(
        sketched.filter("_size > 0 and _id is not null")
        .groupBy("_set")
        .agg(F.min("_id").alias("_node"), F.min("_size").alias("_size"), F.any_value("_keys").alias("_keys"))
    )
    entries = classes.select("_node", "_size", F.explode("_keys").alias("_key"))
    shared = entries.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    entries = checkpointed(entries.join(shared, "_key"))
    company = entries.groupBy("_node").agg(F.sum("_n").alias("_company"))
    hubs = (
        entries.join(company, "_node")
        .groupBy("_key")
        .agg(F.max(F.struct("_company", (-F.col("_node")).alias("_minus"))).alias("_best"))
        .select("_key", (-F.col("_best._minus")).alias("_hub"))
    )
    members = checkpointed(entries.join(hubs, "_key").select("_key", "_node", "_size", "_hub"))
    candidates = checkpointed(members.select("_node").distinct())
    wanted = checkpointed(texts.join(candidates, texts["_id"] == candidates["_node"], "left_semi"))
    pairs = members.filter("_node != _hub").select(F.col("_node").alias("_a"), F.col("_hub").alias("_b")).distinct()
    first = checkpointed(_compared(pairs, wanted, width))
    linked = F.expr(f"100 * _both >= {percent} * (_a_size + _b_size - _both)")
    links = first.filter(linked).select("_a", "_b")
    groups = components(links)

    # what the hubs leave open
    own = groups.select("_node", F.col("_component").alias("_own_group"))
    hub = groups.select(F.col("_node").alias("_hub"), F.col("_component").alias("_hub_group"))
    known = first.select(F.col("_a").alias("_node"), F.col("_b").alias("_hub"), "_both", "_own")
    located = (
        members.join(known, ["_node", "_hub"], "left")
        .join(own, "_node", "left")
        .join(hub, "_hub", "left")
        .select(
            "_key",
            "_node",
            "_size",
            F.coalesce("_own_group", "_node").alias("_group"),
            (F.coalesce("_own_group", "_node") != F.coalesce("_hub_group", "_hub")).alias("_out"),
            F.coalesce("_both", "_size").alias("_both"),
            F.coalesce("_own", F.array().cast("array<long>")).alias("_own"),
        )
    )
    located = checkpointed(located)
    open_keys = located.filter("_out").select("_key").distinct()
    x = located.filter("_out").select([F.col(c).alias(c + "_x") for c in located.columns])
    y = located.join(open_keys, "_key", "left_semi").select([F.col(c).alias(c + "_y") for c in located.columns])
    least = F.least("_both_x", "_both_y")
    most = F.least(least + F.least(F.size("_own_x"), F.size("_own_y")), F.least("_size_x", "_size_y"))
    enough = lambda both: 100 * both >= percent * (F.col("_size_x") + F.col("_size_y") - both)
    rest = (
        x.join(
            y,
            (F.col("_key_x") == F.col("_key_y"))
            & (F.col("_group_x") != F.col("_group_y"))
            & (~F.col("_out_y") | (F.col("_node_x") < F.col("_node_y")))
            & enough(most)
            & enough(least + F.size(F.array_intersect("_own_x", "_own_y"))),
        )
        .select(F.col("_node_x").alias("_a"), F.col("_node_y").alias("_b"))
        .distinct()
    )
    second = checkpointed(_compared(checkpointed(rest), wanted, width).filter(linked).select("_a", "_b"))
    groups = components(links.union(second))
    named = checkpointed(
        classes.join(groups, "_node", "left").select("_set", F.coalesce("_component", "_node").alias("_component"))
    )
    return (
        sketched.select("_id", "_size", "_set")
        .join(named, "_set", "left")
        .select(
            F.col("_id").alias(doc_id),
            F.col("_size").alias("n_shingles"),
            F.coalesce("_component", "_id").alias("component_id"),
            F.coalesce(F.col("_component") == F.col("_id"), F.lit(True)).alias("kept"),
        )
    )
