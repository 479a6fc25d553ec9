"""Helpers of the training-data operators: shared tables, words as Arrow columns, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import shared_folder

#: A word, in Spark's and in DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (`spark.checkpoint.dir`), an error where a cluster names none; local sessions get a scratch folder."""
    return shared_folder(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; the application's id is part of it, so that old ones can be told apart and deleted."""
    return f"{shared_dir(spark)}/loom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def frozen(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there, and rows never change on a recomputation."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def free(name: str, *taken: list[str]) -> str:
    """The name, with as many underscores before it as no column has."""
    known = {c.lower() for columns in taken for c in columns}
    while name.lower() in known:
        name = "_" + name
    return name


def numbered(docs: DataFrame, row: str = "_row", id_col: str = "doc_id") -> DataFrame:
    """The rows with `row`, which tells them apart: the id, if no row is without one and none repeats; else a number, written once."""
    own = F.col(id_col).cast("long")
    ids = docs.groupBy(own.alias("id")).agg(F.count("*").alias("n"))
    if ids.where("id is null or n > 1").isEmpty():
        return docs.withColumn(row, own)
    return frozen(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def few(rows: DataFrame) -> DataFrame:
    """Row numbers are sent to the documents while they are few (8 bytes each); else Spark joins both by number."""
    return F.broadcast(rows) if rows.count() <= 1_000_000 else rows


def without(rows: DataFrame, dropped: DataFrame, row: str = "_row") -> DataFrame:
    return rows.join(few(frozen(dropped, "dropped")), row, "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Neighbouring rows, (first, end), of at most `most` in sum, or one row."""
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            out.append((start, i))
            start, total = i, 0
        total += size
    return [*out, (start, len(sizes))]


def pieces(texts: pa.Array, most: int = 6_000_000) -> Iterator[pa.Array]:
    """A column of texts a few megabytes at a time, in order."""
    give_back()
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes, most):
        yield texts.take(pa.array(np.arange(a, b)))  # a copy: some string kernels misread slices
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system: a worker that waits for its next task would keep it, beside those at work."""
    pa.set_memory_pool(pa.system_memory_pool())
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of every text: (code of each word, first word of each text and the end, the distinct words by code).

    A word is a run of bytes other than space and \\x09-\\x0D. A null text has no words. `lower` folds A-Z only.
    """
    if texts.offset:  # lower-casing misreads slices
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    ends = ends - ends[0]
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if b"" in distinct:  # runs of white space leave empty pieces
        real = codes != distinct.index(b"")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        codes = codes[real]
    return codes, ends, distinct


def hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` neighbouring words, in order of their start."""
    count = len(word_hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[j : j + count]
    return mixed(out)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every end of a link: root is the smallest id that can be reached.

    Rounds of hooking every node to its smallest neighbour and of jumping to that neighbour's own root, until nothing
    changes. Each round aggregates minima only, so that a node with very many links is combined before the shuffle; a round
    is written to the shared folder. No bound on the rounds.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = frozen(both.union(both.select("v", "u")).distinct(), "links")
    roots = frozen(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "roots")
    while True:
        near = edges.join(roots.select(F.col("id").alias("v"), F.col("root").alias("r")), "v").groupBy(F.col("u").alias("id")).agg(F.min("r").alias("r"))
        hooked = roots.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        # what a member has learnt is passed to its old root, so that a long chain shrinks by more than one step a round
        told = hooked.groupBy(F.col("old").alias("id")).agg(F.min("root").alias("t"))
        step = hooked.join(told, "id", "left").select("id", "old", F.least("root", F.coalesce("t", "root")).alias("root"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("j"))
        after = frozen(step.join(jump, "root", "left").select("id", "old", F.least("root", F.coalesce("j", "root")).alias("root")), "roots")
        if after.where("old <> root").isEmpty():
            return after.select("id", "root")
        roots = after.select("id", "root")


def prefix_sums(rows: DataFrame, key: str, order: list[Column], values: dict[str, Column], keep: list[str]) -> DataFrame:
    """`key`, `keep` and the running sums (own row included) of the `values`, none below 0, along `order` within each key.

    Rows are dealt out by ranges of key and order, so that a key with very many rows spans many tasks. Only the first key of a range
    can have begun before it: what the ranges before hold of those few keys is added, at most two rows per range.
    """
    spark = rows.sparkSession
    told = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = told.repartitionByRange(partitions(spark), F.col(key), *order, F.col("_tie")).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy("_range", key).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = frozen(ranged.select(key, "_range", *keep, *[F.sum(v).over(inside).alias(n) for n, v in values.items()]), "prefix")
    firsts = local.groupBy("_range").agg(F.min(key).alias(key)).select(key).distinct()
    ahead = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy(key, "_range").agg(*[F.max(n).alias(n) for n in values]).join(F.broadcast(firsts), key, "left_semi")
    carried = totals.select(key, "_range", *[F.sum(n).over(ahead).alias(f"_{n}") for n in values]).where(F.col(f"_{next(iter(values))}").isNotNull())
    return local.join(F.broadcast(carried), [key, "_range"], "left").select(key, *keep, *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in values])
