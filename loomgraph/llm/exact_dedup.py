"""Exact duplicates by stateful streaming: keyed state on disk, without expiry, and full bytes compared on every hit.

A stream of (digest, document id, content locator) rows feeds an aggregation whose state lives in RocksDB: per digest the
number of rows seen and the identifier and locator of the row that stays. Rows of one digest are combined before they reach the
state, so that a text with very many copies is no hot key. Every micro-batch writes the groups it changed, under its own
number, so that a repeated batch overwrites itself. The state survives with the stream's checkpoint: a later stream over new
documents goes on from it. Spark expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import frozen, shared_path

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # megabytes ahead for each of many small states
}

#: Groups (70 bytes each) up to which their digests are sent to the scans instead of the texts to the digests.
HELD = 200_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keeper_state(arrivals: DataFrame, state_path: str, out_path: str) -> None:
    """Runs the stream of (digest, doc_id, locator) over all that has arrived; writes (digest, n, keeper) changes to `out_path`."""
    spark = arrivals.sparkSession
    groups = arrivals.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("keeper"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        query = groups.writeStream.outputMode("update").option("checkpointLocation", state_path).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def latest(spark: SparkSession, out_path: str) -> DataFrame:
    """(digest, n, keeper): counts and keepers only grow, so the last state of a digest is its largest."""
    schema = "digest string, n long, keeper struct<doc_id: long, locator: long>, batch int"
    return spark.read.schema(schema).parquet(out_path).groupBy("digest").agg(F.max("n").alias("n"), F.max("keeper").alias("keeper"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, row_col: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`, dropped ones too.

    `row_col` names a column of numbers that tell rows apart, which is then returned as well.

    Texts are equal when their bytes are; null counts as empty. The row with the largest doc_id stays (a null id is smaller
    than any); of rows that repeat an id, one. Texts that share a digest but not their bytes (`digest` is a parameter, for
    tests) are told apart by their bytes. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    inbox = shared_path(spark, "arrivals")
    locator = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).cast("string").alias("digest"), sha256(text).alias("text_sha256"), locator.alias("locator")).write.parquet(inbox)
    schema = "doc_id long, digest string, text_sha256 string, locator long"
    out = shared_path(spark, "keepers")
    keeper_state(spark.readStream.schema(schema).parquet(inbox), shared_path(spark, "state"), out)
    arrived = spark.read.schema(schema).parquet(inbox)
    if arrived.isEmpty():
        groups = spark.createDataFrame([], "digest string, n long, keeper struct<doc_id: long, locator: long>")
    else:
        groups = latest(spark, out)
    hits = groups.where("n > 1")
    known = arrived.join(hits, "digest", "left")
    told = verify(rows, known.where("n > 1").select("doc_id", "digest", F.col("keeper.doc_id").alias("keep_id")), digest)
    keeper = F.coalesce("keeper", F.struct("doc_id", "locator"))
    if not told.isEmpty():  # digests whose texts differ: group their rows by the bytes
        odd = told.select("digest").distinct()
        texts = rows.withColumn("digest", digest(F.col("text")).cast("string")).join(odd, "digest", "left_semi")
        exact = arrived.join(odd, "digest", "left_semi").join(texts.select(F.col("doc_id").alias("d"), "text", sha256(F.col("text")).alias("sha")).distinct(),
                             F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("text_sha256")))
        sums = exact.groupBy("text").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("keeper"))
        fixed = exact.join(sums, "text").select("doc_id", "text_sha256", "locator", "n", "keeper")
        known = known.join(odd, "digest", "left_anti").select("doc_id", "text_sha256", "locator", "n", "keeper").union(fixed)
    return known.select(
        "doc_id", keeper["doc_id"].alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (keeper["locator"] == F.col("locator")).alias("kept"), "text_sha256", *([F.col("locator").alias(row_col)] if row_col else []),
    )


def verify(rows: DataFrame, hits: DataFrame, digest) -> DataFrame:
    """Digests of hits (doc_id, digest, keep_id) whose bytes differ from the bytes of the row that stays.

    Only texts of rows in a group go further than the scan. A keeper is one row a digest, so the join's large side can be split where a
    group is hot.
    """
    keyed = rows.withColumn("digest", digest(F.col("text")).cast("string"))
    ids = frozen(hits.select("digest", "keep_id").distinct(), "hits")
    members = frozen(keyed.join(F.broadcast(ids) if ids.count() <= HELD else ids, "digest"), "members")
    keepers = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.max("text").alias("kept_text"))
    return members.join(keepers, "digest").where(F.col("text") != F.col("kept_text")).select("digest")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
