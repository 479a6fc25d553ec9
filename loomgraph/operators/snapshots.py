"""Dated snapshots on disk: a day is one partition, and writing it again replaces that day alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_days(fresh: DataFrame, path: str, day: str = "snapshot_date") -> None:
    """Puts the days of ``fresh`` in place, other days stay; a repeated write changes nothing.

    Only the partitions that ``fresh`` has rows of are swapped, when the whole job commits.
    """
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, schema: str, since: str = "", day: str = "snapshot_date") -> DataFrame:
    """All days, or those from ``since`` on: other folders are not read. ``schema`` includes the day, a string."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.where(f"{day} >= '{since}'") if since else rows
