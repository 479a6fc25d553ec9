"""Ranking metrics over (qid, node_id, rank) runs and (qid, node_id, grade) judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.quality import as_rows, search_quality
from loomgraph.operators.scale import top_per_group


def ranking(scores: DataFrame, k: int) -> DataFrame:
    """Best score per (qid, node), then the first ``k`` of each query."""
    best = scores.groupBy("qid", "node_id").agg(F.max("score").alias("score"))
    return top_per_group(best, ["qid"], [F.desc("score"), F.col("node_id")], k, "rank").select("qid", "node_id", "rank")


def gain(grade: Column, rank: Column) -> Column:
    return grade / F.log2(rank + 1.0)


def ideal(gold: DataFrame, deepest: int) -> DataFrame:
    """Judgments of each query in their best order, down to the deepest cut."""
    return top_per_group(gold, ["qid"], [F.desc("grade"), F.col("node_id")], deepest, "rank")


def ndcg(run: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """NDCG at every cut of ``ks`` in one pass; judged queries without results score 0."""
    def cuts(df: DataFrame, name: str) -> DataFrame:
        sums = [F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank")))).alias(f"{name}{k}") for k in ks]
        return df.groupBy("qid").agg(*sums)

    hits = run.join(gold, ["qid", "node_id"])
    both = cuts(ideal(gold, max(ks)), "i").join(cuts(hits, "d"), "qid", "left")
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.coalesce(F.col(f"d{k}"), F.lit(0.0)) / F.col(f"i{k}"), 6).alias("ndcg")) for k in ks])
    return both.select("qid", F.explode(each).alias("x")).select("qid", "x.k", "x.ndcg")


def hits_by_query(run: DataFrame, gold: DataFrame) -> DataFrame:
    found = gold.join(run.select("qid", "node_id", F.lit(1).alias("hit")), ["qid", "node_id"], "left")
    full = F.col("grade") == 1
    return found.groupBy("qid").agg(
        F.max(F.coalesce("hit", F.lit(0))).alias("any_hit"),
        F.coalesce(F.try_divide(F.count(F.when(full & (F.col("hit") == 1), 1)), F.count(F.when(full, 1))), F.lit(0.0)).alias("part"))


def hit_rates(run: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of queries with any judged hit, and mean share of fully relevant items found."""
    return hits_by_query(run, gold).agg(F.round(F.avg("any_hit"), 6).alias("hit_rate"), F.round(F.avg("part"), 6).alias("relevant_share"))


def zero_result_queries(run: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    good = run.where(F.col("rank") <= k).join(gold, ["qid", "node_id"], "left_semi").select("qid")
    return gold.select("qid").distinct().join(good, "qid", "left_anti")


def rrf_sweep(channels: list[DataFrame], gold: DataFrame, ks: list[int], depth: int) -> DataFrame:
    """Mean NDCG of the fused channels for several fusion constants, all in one plan."""
    union = channels[0]
    for c in channels[1:]:
        union = union.unionByName(c)
    spread = union.withColumn("rrf_k", F.explode(F.array(*[F.lit(k) for k in ks])))
    fused = spread.groupBy("rrf_k", "qid", "node_id").agg(F.round(F.sum(1.0 / (F.col("rrf_k") + F.col("rank"))), 9).alias("score"))
    top = top_per_group(fused, ["rrf_k", "qid"], [F.desc("score"), F.col("node_id")], depth, "rank")
    dcg = (top.join(gold, ["qid", "node_id"], "left").groupBy("rrf_k", "qid")
           .agg(F.sum(gain(F.coalesce("grade", F.lit(0.0)), F.col("rank"))).alias("dcg")))
    best = ideal(gold, depth).groupBy("qid").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("idcg"))
    return dcg.join(best, "qid").groupBy("rrf_k").agg(F.round(F.avg(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"))


def quality_checks(run: DataFrame, gold: DataFrame) -> DataFrame:
    n = ndcg(run, gold, [5, 10]).agg(F.avg(F.when(F.col("k") == 5, F.col("ndcg"))).alias("n5"),
                                     F.avg(F.when(F.col("k") == 10, F.col("ndcg"))).alias("n10"))
    one = n.withColumn("hr", F.lit(hits_by_query(run, gold).agg(F.avg("any_hit")).scalar()))
    return as_rows(one, search_quality(F.col("n5"), F.col("n10"), F.col("hr")))


def pool(channels: list[tuple[str, DataFrame]]) -> DataFrame:
    """Judgment candidates; an item keeps the first channel that offered it."""
    out = None
    for i, (name, df) in enumerate(channels):
        rows = df.select("qid", "node_id", F.struct(F.lit(i).alias("i"), F.lit(name).alias("source")).alias("s"))
        out = rows if out is None else out.unionAll(rows)
    return out.groupBy("qid", "node_id").agg(F.min("s").alias("s")).select("qid", "node_id", "s.source")
