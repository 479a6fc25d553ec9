"""Markdown vault source: files to sections to chunks, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


HEADING = r"(?m)^#{1,3}\s+.+$"
CHARS_PER_TOKEN = 2.5
MIN_CHUNK_CHARS = 20
# Folder name fragments and the project each stands for, first match wins.
PROJECT_HINTS = ["orchestration", "portfolio", "tech-review", "monet-lab"]
EXCLUDED_FOLDERS = [".git", ".obsidian", ".venv", "node_modules", "__pycache__"]


def read_vault(spark: SparkSession, root: str, known_hashes: DataFrame | None = None) -> DataFrame:
    """(path, text, file_hash) of the non-empty markdown files under a folder, without files already ingested."""
    raw = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.md").load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    skip = "/(" + "|".join(f.replace(".", r"\.") for f in EXCLUDED_FOLDERS) + ")/"
    rows = raw.where(~F.col("path").rlike(skip) & (F.trim("text") != "")).withColumn(
        "file_hash", F.substring(F.sha2("text", 256), 1, 16))
    return rows if known_hashes is None else rows.join(known_hashes.select("file_hash"), "file_hash", "left_anti")


def guess_project(path: Column, own_project: str | None = None) -> Column:
    low = F.lower(path)
    out = F.lit("")
    for name in reversed([*PROJECT_HINTS, *([own_project] if own_project else [])]):
        out = F.when(F.contains(low, F.lit(name)), name).otherwise(out)
    return out


def pack_paragraphs(body: Column, max_tokens: int, overlap: bool) -> Column:
    """Chunk texts of a long section: paragraphs are added while they fit; a new chunk repeats the last one."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), empty.alias("cur"), F.lit(0.0).alias("size"))

    def add(acc: Column, para: Column) -> Column:
        size = F.length(para) / CHARS_PER_TOKEN
        full = (acc["size"] + size > max_tokens) & (F.size(acc["cur"]) > 0)
        last = F.element_at(acc["cur"], -1)
        carried = F.array(last, para) if overlap else F.array(para)
        carried_size = (F.length(last) / CHARS_PER_TOKEN if overlap else F.lit(0.0)) + size
        return F.struct(F.when(full, F.array_append(acc["out"], F.array_join(acc["cur"], "\n\n"))).otherwise(acc["out"]).alias("out"),
                        F.when(full, carried).otherwise(F.array_append(acc["cur"], para)).alias("cur"),
                        F.when(full, carried_size).otherwise(acc["size"] + size).alias("size"))

    return F.aggregate(F.split(body, "\n\n+"), start, add, lambda acc: F.array_append(acc["out"], F.array_join(acc["cur"], "\n\n")))


def chunk(docs: DataFrame, max_tokens: int = 400, overlap_tokens: int = 50) -> DataFrame:
    """Chunks of (doc, text): one per section, or several where a section exceeds the token budget."""
    parts = F.split("text", r"(?m)(?=^#{1,3}\s+.+$)")
    sec = docs.select("doc", F.posexplode(parts).alias("section", "raw"))
    heading = F.trim(F.regexp_extract("raw", r"^#{1,3}\s+(.+)", 1))
    sec = sec.withColumn("heading", heading).withColumn(
        "body", F.regexp_replace(F.regexp_replace("raw", r"^#{1,3}\s+.+", ""), r"^\s+|\s+$", "")).where("body <> ''")
    long = F.length("body") / CHARS_PER_TOKEN > max_tokens
    texts = F.when(long, pack_paragraphs(F.col("body"), max_tokens, overlap_tokens > 0)).otherwise(F.array("body"))
    head = F.when(F.col("heading") != "", F.concat(F.lit("## "), F.col("heading"), F.lit("\n"))).otherwise("")
    rows = sec.select("doc", "section", "heading", head.alias("head"), F.posexplode(texts).alias("part", "text"))
    return rows.select("doc", "section", "part", "heading", F.concat("head", "text").alias("content")).where(
        F.length(F.trim("content")) >= MIN_CHUNK_CHARS)


def same_file_edges(chunks: DataFrame) -> DataFrame:
    """``part_of`` edges from every chunk (doc, id) to the first chunk of its file."""
    first = chunks.groupBy("doc").agg(F.min("id").alias("target_id"))
    return chunks.join(first, "doc").where("id <> target_id").select(
        F.col("id").alias("source_id"), "target_id", F.lit("part_of").alias("relation"), F.lit(0.7).alias("strength"))
