"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on about ``SAMPLE`` vectors chosen by a hash; every vector of the table is then filed under the leaf
that it reaches by the nearest centre at each level. A query walks the tree best bin first: a priority queue holds the
branches not taken with a bound on how near their cells can be, and the next leaf is always below the nearest branch.
The number of leaves to visit is widened on sample queries, compared with all sample vectors, until ``RECALL`` is
reached; as the whole table is denser than the sample, its neighbours are nearer and the recall higher.

Equal vectors are filed once with the smallest ids that can be among the nearest. A leaf with many vectors is dealt
out in blocks, and the queries that visit a leaf in parts, so a task holds a bounded number of both.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewinds.llm.components import checkpointed

SAMPLE, BRANCHES, LEAF = 20_000, 8, 64
RECALL, TRIED = 0.97, 200
BLOCK, PART = 4096, 20_000  # distinct vectors of a leaf and queries that a task holds


class Tree(NamedTuple):
    centres: np.ndarray
    first: np.ndarray  # first child of each node; its children stand side by side
    count: np.ndarray  # number of children; 0 for a leaf

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.count == 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _k_means(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[random.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)[:, None]
        centres = np.where(n > 0, total / np.maximum(n, 1), centres)
    return centres[np.unique(_nearest(x, centres))]


def build_tree(sample: np.ndarray) -> Tree:
    """Split the sample in up to ``BRANCHES`` clusters again and again until a cluster has at most ``LEAF`` vectors."""
    random = np.random.default_rng(0)
    centres, first, count, todo = [sample.mean(axis=0)], [0], [0], [(0, sample)]
    for node, x in todo:
        if len(x) <= LEAF:
            continue
        split = _k_means(x, BRANCHES, random)
        if len(split) < 2:
            continue
        own = _nearest(x, split)
        first[node], count[node] = len(centres), len(split)
        for k, centre in enumerate(split):
            todo.append((len(centres), x[own == k]))
            centres.append(centre)
            first.append(0)
            count.append(0)
    return Tree(np.array(centres), np.array(first), np.array(count))


def file_under(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of every vector."""
    node = np.zeros(len(x), dtype=np.int64)
    while True:
        inner = np.unique(node[tree.count[node] > 0])
        if not len(inner):
            return node
        for k in inner:
            at = np.flatnonzero(node == k)
            node[at] = tree.first[k] + _nearest(x[at], tree.centres[tree.first[k] : tree.first[k] + tree.count[k]])


def visits(tree: Tree, query: np.ndarray, most: int) -> list[int]:
    """The first ``most`` leaves, best bin first."""
    queue, found = [(0.0, 0)], []
    while queue and len(found) < most:
        bound, node = heapq.heappop(queue)
        while tree.count[node]:
            a = tree.first[node]
            centres = tree.centres[a : a + tree.count[node]]
            far = ((centres - query) ** 2).sum(axis=1)
            best = int(far.argmin())
            between = np.sqrt(((centres - centres[best]) ** 2).sum(axis=1))
            # how far the query is from the border between the nearest centre's cell and each other cell
            border = (far - far[best]) / (2 * np.maximum(between, 1e-12))
            for k, b in enumerate(border.tolist()):
                if k != best:
                    heapq.heappush(queue, (max(bound, b), int(a + k)))
            node = int(a + best)
        found.append(node)
    return found


def calibrate(tree: Tree, sample: np.ndarray, k: int) -> int:
    """The number of leaves to visit for ``RECALL`` of the ``k`` nearest, as tried on the sample."""
    leaf, n_leaves = file_under(tree, sample), len(tree.leaves)
    needed = []
    for q in range(min(TRIED, len(sample))):
        far = ((sample - sample[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        near = np.argsort(far, kind="stable")[: min(k, len(sample) - 1)]
        place = np.empty(len(tree.count), dtype=np.int64)
        order = visits(tree, sample[q], n_leaves)
        place[order] = np.arange(len(order))
        needed.append(place[leaf[near]])
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0, dtype=np.int64)
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1 if len(needed) else n_leaves


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, dtype=np.float64).reshape(len(rows), -1)


def _filing(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = file_under(tree, _matrix(batch.column("_v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "_leaf"])

    return run


def _walking(tree: Tree, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                found = [visits(tree, q, most) for q in _matrix(batch.column("_v"))]
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_q").take(pa.array(row)), pa.array(np.concatenate(found), pa.int32())], names=["_q", "_leaf"]
                )

    return run


def _searching(k: int):
    def run(filed: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if filed.num_rows and asked.num_rows:
            v, ids = _matrix(filed.column("_v")), filed.column("_ids").to_pylist()
            for number, q in zip(asked.column("_q").to_pylist(), _matrix(asked.column("_v")), strict=True):
                far = np.sqrt(((v - q) ** 2).sum(axis=1))
                cut = np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf
                near = sorted((far[i], j) for i in np.flatnonzero(far <= cut) for j in ids[i])[:k]
                out.append((number, [j for _, j in near], [float(s) for s, _ in near]))
        q, ids, scores = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_arrays(
            [pa.array(q, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))],
            names=["_q", "_ids", "_scores"],
        )

    return run


def _shares(rows: DataFrame, most: int) -> Column:
    """Into how many shares of about ``most`` the rows of each leaf are to be dealt. Collects as many rows as leaves."""
    large = {r[0]: -(-r[1] // most) for r in rows.groupBy("_leaf").count().filter(F.col("count") > most).collect()}
    if not large:
        return F.lit(1)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in large.items() for x in pair])[F.col("_leaf")], F.lit(1))


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest vectors found for each row where ``is_query`` holds, by Euclidean distance, nearest first.

    Returns query_id, rank (from 1), vec_id and score, the distance of the original vectors in double precision; ties
    go to the smaller id, a row is no neighbour of itself, and a query has fewer rows only if fewer candidates exist.
    Vectors that are null, zero, or hold a null or non-finite component take no part, as do rows without an id and
    vectors of another length than most have. Repeated rows count once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    size = lambda x: (F.abs(x) < float("inf")) & ~F.isnan(x)
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("_id"), F.col(embedding).cast("array<double>").alias("_v"), is_query.alias("_asks")
    ).filter(
        F.col("_id").isNotNull()
        & (F.size("_v") > 0)
        & F.forall("_v", lambda x: F.coalesce(size(x), F.lit(False)))
        & F.exists("_v", lambda x: x != 0)
    )
    length = rows.groupBy(F.size("_v").alias("_n")).count().orderBy(F.desc("count"), "_n").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not length:
        return spark.createDataFrame([], empty)
    rows = rows.filter(F.size("_v") == length[0][0])
    # Spark limits each vector's rows before the shuffle as well
    smallest = Window.partitionBy("_v").orderBy("_id")
    distinct = checkpointed(
        rows.select("_id", "_v").withColumn("_r", F.dense_rank().over(smallest)).filter(F.col("_r") <= k + 1)
        .groupBy("_v").agg(F.array_sort(F.collect_set("_id")).alias("_ids"))
    )
    total, parts = distinct.count(), 1 << 20
    draw = F.pmod(F.xxhash64(F.lit("tree"), F.col("_ids")[0]), F.lit(parts)) < int(parts * min(1.0, SAMPLE / total)) + 1
    sample = np.array([r[0] for r in distinct.filter(draw).orderBy(F.xxhash64(F.col("_ids")[0])).select("_v").collect()], dtype=np.float64)
    if not len(sample):
        sample = np.array([distinct.first()["_v"]], dtype=np.float64)
    tree = build_tree(sample)
    most = calibrate(tree, sample, k)
    filed = checkpointed(distinct.mapInArrow(_filing(tree), "_v array<double>, _ids array<long>, _leaf int"))
    asking = checkpointed(rows.filter("_asks").select("_id", "_v").distinct())
    questions = checkpointed(asking.groupBy("_v").agg(F.min("_id").alias("_q")))
    walked = checkpointed(questions.select("_q", "_v").mapInArrow(_walking(tree, most), "_q long, _leaf int"))
    blocks, parts = _shares(filed, BLOCK), _shares(walked, PART)
    asked = (
        walked.withColumn("_part", F.pmod(F.xxhash64("_q"), parts).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .join(questions, "_q")
    )
    filed = filed.withColumn("_block", F.pmod(F.xxhash64(F.col("_ids")[0]), blocks).cast("int")).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    found = (
        filed.groupBy("_leaf", "_block", "_part")
        .cogroup(asked.groupBy("_leaf", "_block", "_part"))
        .applyInArrow(_searching(k + 1), "_q long, _ids array<long>, _scores array<double>")
        .select("_q", F.explode(F.arrays_zip("_ids", "_scores")).alias("_f"))
        .select("_q", F.col("_f._ids").alias("_near"), F.col("_f._scores").alias("_score"))
    )
    best = Window.partitionBy("_q").orderBy("_score", "_near")
    found = checkpointed(found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r"))
    # every asking row has the neighbours of its vector, but for itself
    askers = checkpointed(asking.join(questions, "_v").select("_id", "_q"))
    own = Window.partitionBy("_id").orderBy("_score", "_near")
    return (
        askers.join(found, "_q")
        .filter("_near != _id")
        .withColumn("_r", F.row_number().over(own))
        .filter(F.col("_r") <= k)
        .select(F.col("_id").alias("query_id"), F.col("_r").cast("int").alias("rank"), F.col("_near").alias("vec_id"), F.col("_score").alias("score"))
    )
