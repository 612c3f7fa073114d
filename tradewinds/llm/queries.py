"""The named queries of this subpackage: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewinds.llm.bpe import encode_and_decode
from tradewinds.llm.brown import score_texts
from tradewinds.llm.chat_format import SAY, calls_of_conversations, link_tool_calls, with_messages
from tradewinds.llm.decontamination import find_contamination
from tradewinds.llm.html_text import extract_main_text
from tradewinds.llm.language_id import identify_languages
from tradewinds.llm.lexical_search import search
from tradewinds.llm.minhash import near_duplicate_groups
from tradewinds.llm.neighbours import nearest_neighbours
from tradewinds.llm.oracles import ORACLES
from tradewinds.llm.quality import score_quality
from tradewinds.llm.substring_dedup import remove_repeats
from tradewinds.llm.target_resampling import resample
from tradewinds.llm.token_counts import count_tokens

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(_read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = remove_repeats(_read(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = _read(spark, folder, "conversations")
    done = with_messages(turns, link_tool_calls(*calls_of_conversations(turns), SAY))
    return done.select(
        "conv_id", "turn", "place", "kind", "call_id", "status", "valid", F.array_join("errors", "; ").alias("errors"), "json"
    )


def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(_read(spark, folder, "documents"))


def _remainder(column: str, of: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(_read(spark, folder, "pages"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").withColumn("held_out", _remainder("doc_id", 5) == 0)
    done = identify_languages(docs, ~F.col("held_out"), keep=("held_out",))
    return done.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    done = encode_and_decode(_read(spark, folder, "documents"), str(path), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    held_out = _remainder("doc_id", 3) == 1
    done = score_quality(docs.withColumn("held_out", held_out), labels, ~held_out, keep=("held_out",))
    return done.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").withColumn("held_out", _remainder("doc_id", 7) == 2)
    done = score_texts(docs, ~F.col("held_out"), keep=("held_out",))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return count_tokens(_read(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op13_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours,
        op2_substring_dedup,
        op3_html_extraction,
        op4_language_id,
        op5_bpe,
        op6_quality_classifier,
        op7_lm_scoring,
        op8_decontamination,
        op9_chat_format,
        op10_minhash_near_dedup,
        op11_lexical_search,
        op12_token_counts,
        op13_target_resampling,
    )
}
