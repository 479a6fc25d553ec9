"""The corpus pipeline: quality, exact copies, near copies, mixture, tokens. Every stage reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, exact_dedup, minhash, mixing, quality
from loomgraph.llm.common import few, free, frozen, numbered, partitions, without

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Megabytes of an Arrow batch of texts; a batch of the last stage is a block within which words are told apart, so it is larger.
BATCH_MB, BLOCK_MB = 4, 8
#: Word buckets of the last stage for every shuffle partition: a bucket is a group in one task.
BUCKETS = 4


def bounded(spark: SparkSession, megabytes: int) -> None:
    """From here on texts cross to Python and back in batches of so many megabytes, not of so many rows, however long they are.

    The session keeps the setting, as a stage's result is computed after it has returned; each stage sets its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of good quality is at least one half."""
    bounded(spark, BATCH_MB)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest id."""
    bounded(spark, BATCH_MB)
    row = free("_row", docs.columns)
    rows = numbered(docs, row)
    dropped = exact_dedup.dedup(rows, row_col=row).where("not kept").select(row)
    return without(rows, dropped, row).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, that of the smallest id. A row is a node of its own, whatever its id."""
    bounded(spark, BATCH_MB)
    row = free("_row", docs.columns)
    rows = numbered(docs, row)
    others = frozen(minhash.near_duplicates(rows, id_col=row).where("not kept").select(F.col("doc_id").alias("node"), "component_id"), "others")
    members = others.union(others.select("component_id", "component_id").distinct())
    ids = rows.select(F.col(row).alias("node"), "doc_id").join(few(members.select("node")), "node", "left_semi")
    first = members.join(ids, "node").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")).select("first.node")
    return without(rows, members.select("node").join(first, "node", "left_anti").select(F.col("node").alias(row)), row).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document once for every pass over it; the texts of partial passes are the blocks that were drawn."""
    bounded(spark, BATCH_MB)
    row = free("_mix_row", docs.columns)
    rows = frozen(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    sizes = mixing.measured(rows, row_col=row)
    draws = mixing.mix(sizes, mixing.targets(sizes))
    texts = mixing.mixed_texts(rows, draws, row).withColumn("n_chars", F.length("text").cast("long"))
    return texts.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    bounded(spark, BLOCK_MB)
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, buckets=BUCKETS * partitions(spark))
    return bpe.digests(encoded, RANKS, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mixing", mixed), ("tokens", tokens),
]
#: Stages with learnt models, sketches and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
