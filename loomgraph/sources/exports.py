"""Line exports of the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_text() -> Column:
    concepts = F.when(F.size("key_concepts") > 0, F.concat(F.lit("[concepts] "), F.array_join("key_concepts", ", ")))
    summary = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("[summary] "), F.col("summary")))
    return F.concat_ws(" | ", F.nullif("content", F.lit("")), summary, concepts)


def export_rows(nodes: DataFrame, status: str = "", min_quality: float | None = None) -> DataFrame:
    rows = nodes.where("status <> 'deleted'")
    rows = rows.where(F.col("status") == status) if status else rows
    rows = rows.where(F.col("quality_score") >= min_quality) if min_quality is not None else rows
    return rows.withColumn("search_text", search_text())


def json_lines(nodes: DataFrame, status: str = "", min_quality: float | None = None) -> DataFrame:
    """One JSON document per node, ready for ``write.text``."""
    rows = export_rows(nodes, status, min_quality)
    body = F.struct(F.col("id").alias("node_id"), *[F.col(c) for c in rows.columns if c not in ("id", "embedding")])
    return rows.select(F.to_json(F.struct(F.concat(F.lit("node_"), F.col("id").cast("string")).alias("id"), body.alias("structData"))).alias("value"))
