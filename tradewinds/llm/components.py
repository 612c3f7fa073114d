"""Connected components of links between ids, by smallest labels and pointer jumping."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session without one, as in tests, gets one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="corpus-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(_node, _component) for every node of ``links`` (_a, _b): the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so the rounds needed
    grow with the logarithm of a chain's length. Minima are combined before the shuffle and the joins are between
    plainly shuffled tables, which Spark splits if a node has very many links.
    """
    both = checkpointed(links.select("_a", "_b").union(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("_a").alias("_node")).agg(F.least(F.col("_node"), F.min("_b")).alias("_component")))
    while True:
        near = both.join(labels, both["_b"] == labels["_node"]).groupBy(F.col("_a").alias("_node")).agg(F.min("_component").alias("_near"))
        met = labels.join(near, "_node").select("_node", "_component", F.least("_component", "_near").alias("_low"))
        up = labels.select(F.col("_node").alias("_low"), F.col("_component").alias("_jump"))
        # a label is a node too, as labels are ids of nodes
        new = checkpointed(met.join(up, "_low").select("_node", F.least("_low", "_jump").alias("_new"), "_component"))
        changed = new.filter(F.col("_new") != F.col("_component")).limit(1).count()
        labels = new.select("_node", F.col("_new").alias("_component"))
        if not changed:
            return labels
