"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import ann, bpe, chat, exact_dedup, minhash, mixing, quality, sharding, spelling, substrings, toxicity, turn_trie, url_filter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN), RANKS)


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages")).withColumn("score", F.round("score", 6))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, folder, "documents"))


def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.measured(table(spark, folder, "documents"))
    goal = mixing.targets(sizes)
    return mixing.taken(sizes, goal, mixing.mix(sizes, goal))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")
    return found.select("doc_id", F.col("_own").alias("document_log_odds"), F.col("_path").alias("path_rate"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).alias("kept"))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    same = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.read_back(chat.format_chats(turns)))


def op10_ann_search(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"))


def op11_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assigned(table(spark, folder, "documents"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op13_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turn_trie.trie(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_byte_bpe, op2_url_filter, op3_exact_dedup, op4_source_mix, op5_quality, op6_near_dedup, op7_toxicity, op8_substring_dedup, op9_chat_format, op10_ann_search, op11_hash_tree, op12_spelling, op13_turn_trie,
)}
#: The others learn, sketch, draw or search; tests hold them against brute force, exact round trips or held-out labels.
SQL: dict[str, str] = {"op2_url_filter": url_filter.SQL, "op3_exact_dedup": exact_dedup.SQL, "op8_substring_dedup": substrings.SQL, "op9_chat_format": chat.SQL, "op11_hash_tree": sharding.SQL,
                       "op12_spelling": spelling.SQL, "op13_turn_trie": turn_trie.SQL}
