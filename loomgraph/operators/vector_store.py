"""A kept vector table: a snapshot and a log of changes after it, merged when read.

Changes (rows added or replaced, ids removed) are appended as one numbered log entry each, so an update costs what it changes. A read
takes the snapshot without the ids that the log speaks about, and of those the last entry, unless it is a removal. ``compact``
writes a new snapshot and starts an empty log. The manifest names snapshot and log entries of every version; a reader keeps the
version it opened, and versions that are no longer named may be deleted.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import shared_folder

MANIFEST = "version int, snapshot string, log array<string>"


class VectorStore:
    """One version of a store; rows are (id bigint, embedding array<float>)."""

    def __init__(self, spark: SparkSession, path: str, version: int, snapshot: str, log: list[str]):
        self.spark, self.path, self.version, self.snapshot, self.log = spark, path, version, snapshot, log

    @staticmethod
    def create(rows: DataFrame, path: str | None = None) -> VectorStore:
        spark = rows.sparkSession
        store = VectorStore(spark, path or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", 0, "", [])
        return store._snapshot(_typed(rows))

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorStore:
        row = spark.read.schema(MANIFEST).json(f"{path}/manifest/*").orderBy(F.desc("version")).first()
        return VectorStore(spark, path, row["version"], row["snapshot"], list(row["log"]))

    def put(self, rows: DataFrame) -> VectorStore:
        """The version after rows were added, or replaced where their id is known; of rows that repeat an id one is taken."""
        return self._logged(_typed(rows).dropDuplicates(["id"]).withColumn("live", F.lit(True)))

    def remove(self, ids: DataFrame) -> VectorStore:
        return self._logged(ids.select(F.col("id").cast("bigint").alias("id"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(False).alias("live")).distinct())

    def rows(self) -> DataFrame:
        """(id, embedding) as of this version."""
        base = self.spark.read.schema("id bigint, embedding array<float>").parquet(f"{self.path}/{self.snapshot}")
        if not self.log:
            return base
        entries = [self.spark.read.schema("id bigint, embedding array<float>, live boolean").parquet(f"{self.path}/{e}").withColumn("at", F.lit(k)) for k, e in enumerate(self.log)]
        last = reduce(DataFrame.unionAll, entries).groupBy("id").agg(F.max_by(F.struct("live", "embedding"), "at").alias("l"))
        return base.join(last.select("id"), "id", "left_anti").unionByName(last.where("l.live").select("id", "l.embedding"))

    def compact(self) -> VectorStore:
        return self._snapshot(self.rows())

    def stats(self) -> DataFrame:
        """Vectors, their least and greatest length, and their bytes as 32-bit numbers."""
        size = F.size("embedding")
        return self.rows().agg(F.count("*").alias("vectors"), F.min(size).cast("bigint").alias("least_dim"), F.max(size).cast("bigint").alias("most_dim"), (F.sum(size) * 4).alias("bytes"))

    def _snapshot(self, rows: DataFrame) -> VectorStore:
        name = f"snapshot-{self.version + 1}"
        rows.write.parquet(f"{self.path}/{name}")
        return self._noted(name, [])

    def _logged(self, rows: DataFrame) -> VectorStore:
        name = f"log-{self.version + 1}"
        rows.write.parquet(f"{self.path}/{name}")
        return self._noted(self.snapshot, [*self.log, name])

    def _noted(self, snapshot: str, log: list[str]) -> VectorStore:
        after = VectorStore(self.spark, self.path, self.version + 1, snapshot, log)
        self.spark.createDataFrame([(after.version, snapshot, log)], MANIFEST).coalesce(1).write.json(f"{self.path}/manifest/{after.version}")
        return after


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
