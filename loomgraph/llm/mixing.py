"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources by code point weigh 5, 2, 1 in turn and share 150 % of all words; no source goes beyond twice its size, the
excess is shared again by weight. Documents are cut into blocks of words; a seeded hash permutes the blocks of a source, and
whole passes over it plus the head of one more give exactly the rounded target (the last block is cut). The tree then
deals the drawn blocks out: a node holds a number of draws of every source; its children's numbers are drawn without
replacement (multivariate hypergeometric), level by level, so that every shard has the mixture by chance and all numbers
add up. A shard takes its stretch of each source's permutation, and is shuffled within itself.

The permutation is ranked bucket by bucket (a source of any size has as many buckets as it needs), never source by
source. Shards grow in number, not in size. A node's split is one task over one row per source.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, free, frozen, partitions

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BLOCK_WORDS = 256
#: Blocks of a bucket of the permutation, draws of a shard, children of a node.
BUCKET, SHARD, FAN = 4_000, 20_000, 16


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(row, doc_id, source, size), written once: `row` tells repeated rows apart from then on; `row_col` names it if the documents have it already."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return frozen(docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                              F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")


def ranked(names: DataFrame, column: str) -> DataFrame:
    """Adds `place` (from 0) by code point, nulls last: ranges of names, counted, then numbered each on its own."""
    spark = names.sparkSession
    order = F.col(column).asc_nulls_last()
    ranges = frozen(names.repartitionByRange(partitions(spark), order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = sorted((r["range"], r["count"]) for r in ranges.groupBy("range").count().collect())  # a row per range
    before = np.concatenate([[0], np.cumsum([c for _, c in counts])[:-1]]).astype(int) if counts else []
    offsets = spark.createDataFrame([(r, int(b)) for (r, _), b in zip(counts, before, strict=True)], "range int, before long")
    here = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranges.join(offsets, "range").withColumn("place", F.col("before") + here).drop("range", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target). Only sums over sources come to the driver, one round per change of the capped ones."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = frozen(ranked(totals, "source").withColumn("weight", weight.cast("double")), "sources")
    budget = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        free = F.col("weight") * level <= cap * F.col("source_size")
        got = rows.agg(F.sum(F.when(free, 0).otherwise(F.col("source_size"))).alias("full"), F.sum(F.when(free, F.col("weight")).otherwise(0.0)).alias("open")).first()
        after = (share * budget - cap * got["full"]) / got["open"] if got["open"] else level
        if after <= level:
            break
        level = after
    return rows.select("source", "source_size", F.least(F.col("weight") * level, cap * F.col("source_size")).cast("double").alias("target"))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among `drawn` of good + bad; by the normal law, kept within its bounds, beyond what the exact sampler takes."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn and good else 0
    total = good + bad
    mean, p = drawn * good / total, good / total
    spread = math.sqrt(max(0.0, mean * (1 - p) * (total - drawn) / (total - 1)))
    return int(min(max(round(rng.normal(mean, spread)), drawn - bad, 0), good, drawn))


def deal(quotas: list[int], leaves: int, fan: int, rng: np.random.Generator) -> list[tuple[int, list[int]]]:
    """(leaves, quotas) of a node's children; capacities are in proportion to leaves, quotas add up exactly."""
    many = min(fan, leaves)
    own = [leaves // many + (c < leaves % many) for c in range(many)]
    left, total, out, seen = list(quotas), sum(quotas), [], 0
    for c, n in enumerate(own):
        before, seen = seen, seen + n
        room = total * seen // leaves - total * before // leaves
        got, rest = [], sum(left)
        for s, quota in enumerate(left):
            rest -= quota
            g = hypergeometric(rng, quota, rest, room) if c + 1 < many else quota
            got.append(g)
            room -= g
            left[s] -= g
        out.append((n, got))
    return out


def mix(sizes: DataFrame, goal: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, bucket: int = BUCKET, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """The draws: (row, doc_id, source, pass, block, start, take, shard, position): `take` words from word `start` of a document.

    `sizes` and `goal` come from `measured` and `targets`. Documents without words are never drawn. The seed decides all;
    repeated rows of one document are different draws.
    """
    spark = sizes.sparkSession
    quota = F.round("target").cast("long")
    blocks_of = sizes.groupBy(F.col("source").alias("c")).agg(F.sum(F.ceil(F.col("size") / block_words)).cast("long").alias("source_blocks"))
    plan = goal.where("source_size > 0").join(blocks_of, F.col("source").eqNullSafe(F.col("c"))).select(
        F.col("source").alias("s"), "source_blocks", F.floor(quota / F.col("source_size")).cast("int").alias("passes"), (quota % F.col("source_size")).alias("rest"),
        F.ceil(F.col("source_blocks") / bucket).cast("long").alias("buckets"))
    plan = frozen(plan, "plan")
    blocks = sizes.where("size > 0").join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "row", "doc_id", "source", "source_blocks", "passes", "rest", "buckets", "size", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / block_words) - 1).cast("int"))).alias("block"))
    blocks = blocks.withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words)).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "block"))
    blocks = blocks.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.col("buckets"))).drop("buckets", "size")
    ahead = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    sums = sums.select("s", "b", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("blocks_before"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "block", "row")
    placed = (blocks.withColumn("from", F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(inside) - 1)
              .join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
              .withColumns({"from": F.col("from") + F.col("words_before"), "nth": F.col("nth") + F.col("blocks_before")}))
    passes = F.sequence(F.lit(0), F.col("passes") - F.when(F.col("from") < F.col("rest"), 0).otherwise(1))
    draws = placed.where("passes > 0 or from < rest").withColumn("pass", F.explode(passes)).select(
        "row", "doc_id", "source", "pass", "block", (F.col("block") * block_words).alias("start"),
        F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("from"))).cast("long").alias("take"),
        (F.col("pass") * F.col("source_blocks") + F.col("nth")).alias("idx"))
    draws = frozen(draws, "draws")

    # the tree
    quotas = draws.groupBy("source").agg(F.count("*").alias("quota"))
    total = draws.count()
    leaves = max(1, -(-total // shard))
    level_rows = frozen(quotas.select(F.lit(0).cast("long").alias("node"), F.lit(leaves).cast("long").alias("leaves"), "source", "quota", F.lit(0).cast("long").alias("base")), "node")
    draws = draws.withColumn("node", F.lit(0).cast("long"))
    level = 0
    while leaves > 1:
        depth = level

        def split(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.assign(last=rows["source"].isna()).sort_values(["last", "source"])
            node, quota, base = int(rows["node"].iloc[0]), rows["quota"].tolist(), rows["base"].to_numpy()
            out = []
            for c, (n, got) in enumerate(deal(quota, int(rows["leaves"].iloc[0]), fan, np.random.default_rng([seed, depth, node]))):
                out.append(pd.DataFrame({"node": node * fan + c, "leaves": n, "source": rows["source"].to_numpy(), "quota": got, "base": base}))
                base = base + np.array(got)
            whole = pd.concat(out)
            return whole[whole["quota"] > 0]

        level_rows = frozen(level_rows.groupBy("node").applyInPandas(split, level_rows.schema), "node")
        stretch = level_rows.groupBy(F.floor(F.col("node") / fan).alias("up"), F.col("source").alias("s")).agg(F.array_sort(F.collect_list(F.struct("base", "node"))).alias("children"))
        draws = draws.join(stretch, (F.col("node") == F.col("up")) & F.col("source").eqNullSafe(F.col("s"))).withColumn(
            "node", F.element_at(F.filter("children", lambda c: c["base"] <= F.col("idx")), -1)["node"]).drop("up", "s", "children")
        leaves, level = -(-leaves // min(fan, leaves)), level + 1
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "block", "pass"), "source", "idx")
    return draws.withColumnRenamed("node", "shard").withColumn("position", F.row_number().over(local) - 1).drop("idx")


def taken(sizes: DataFrame, goal: DataFrame, draws: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) for every row of `sizes`, drawn or not."""
    sums = draws.groupBy("row").agg(F.sum("take").alias("taken"), F.count_distinct("shard").alias("shards"))
    rows = sizes.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).join(sums, "row", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("shards", F.lit(0)).alias("shards"))


def mixed_texts(docs: DataFrame, draws: DataFrame, row_col: str, text_col: str = "text") -> DataFrame:
    """`docs`, a row for every pass over a document: whole documents as they are, else the drawn words joined by spaces; `row_col` is the row that was drawn."""
    row, nth, parts, count, split = (free(f"_{n}", docs.columns) for n in ("drawn", "pass", "parts", "words", "all"))
    drawn = draws.groupBy(F.col("row").alias(row), F.col("pass").alias(nth)).agg(F.array_sort(F.collect_list(F.struct("start", "take"))).alias(parts), F.sum("take").alias(count))
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(split, (p["start"] + 1).cast("int"), p["take"].cast("int")))), " ")
    rows = docs.join(drawn, F.col(row_col) == F.col(row)).withColumn(split, words)  # texts are shuffled, not their words
    return rows.withColumn(text_col, F.when(F.size(split) == F.col(count), F.col(text_col)).otherwise(cut)).select(*docs.columns)


def share_of(weights: tuple[int, ...], sizes: list[int], share: float = SHARE, cap: float = CAP) -> list[Fraction]:
    """The targets of a list of sources (in order), exactly, for tests."""
    budget, open_ = Fraction(share) * sum(sizes), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        over = {i for i in open_ if budget * weights[i % len(weights)] / total > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = budget * weights[i % len(weights)] / total
            return out
        for i in over:
            out[i] = Fraction(cap) * sizes[i]
            budget -= out[i]
        open_ -= over
    return out
