"""A training corpus from raw documents: quality, near-duplicates, repeated passages, benchmark passages, tokens."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewinds.llm.bpe import encode_and_decode
from tradewinds.llm.components import shared_folder
from tradewinds.llm.decontamination import find_contamination
from tradewinds.llm.minhash import near_duplicate_groups
from tradewinds.llm.quality import score_quality
from tradewinds.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REST = COLUMNS[1:]
VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier gives at least an even chance of being good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    return score_quality(docs, labels, learn, keep=_REST).filter("score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of near-duplicates."""
    gone = near_duplicate_groups(docs, width=5).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words of passages that a document with a smaller id holds; documents that lose none stay as they are."""
    done = remove_repeats(docs.withColumn("_given", F.col("text").isNotNull()), keep=(*_REST[1:], "_given"), whole=True)
    text = F.when(F.col("_given"), F.col("kept_text"))
    changed = done.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return changed.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are not contaminated by the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(docs, benchmark, keep=_REST).filter("not contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text again."""
    import public_tokenizers

    path = str(public_tokenizers.path(VOCABULARY))
    done = encode_and_decode(docs, path, public_tokenizers.PATTERN, keep=_REST)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
# a trained classifier decides what goes on, which SQL can't repeat
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage returns is written to the shared folder and read again.

    Documents may hold nulls anywhere, be empty or repeated and have further columns, which are left out; a table
    without rows gives none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
