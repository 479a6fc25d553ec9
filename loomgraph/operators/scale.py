"""Building blocks that keep results exact when one key holds a large share of the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from loomgraph.operators.cells import pairs_in_cells
from loomgraph.session import cut_lineage


def top_per_group(df: DataFrame, keys: list, order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key, with their rank.

    ``row_number() <= k`` lets Spark put a WindowGroupLimit below the shuffle,
    so every map task forwards at most ``k`` rows of a hot key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def best_row(df: DataFrame, keys: list[str], by: Column, cols: list[str], largest: bool = True) -> DataFrame:
    """One row per key by max_by/min_by: map-side combined, no per-key sort."""
    pick = F.max_by if largest else F.min_by
    row = F.struct(*[F.col(c) for c in cols])
    return df.groupBy(*keys).agg(pick(row, by).alias("_row")).select(*keys, "_row.*")


def duplicate_groups(df: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """Rows of groups with more than one member, each with its keeper.

    The keeper and the size come from one partially aggregated groupBy; the
    rows meet them again by an equi-join, which AQE splits where a group is
    hot. No group is ever gathered in one task.
    """
    keeper = F.min(F.struct(*order)).alias("_first")
    groups = (df.groupBy(*keys).agg(F.count("*").alias("group_size"), keeper)
              .where(F.col("group_size") > 1)
              .select(*keys, "group_size", F.col("_first.id").alias("keep_id")))
    rows = df.select(*keys, *payload)
    same = [rows[k].eqNullSafe(groups[k]) for k in keys]  # rows without a project are a group too
    return rows.join(groups, same).select(*[rows[c] for c in rows.columns], "group_size", "keep_id")


def carry_previous(df: DataFrame, key: str, bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """``lag(value)`` per key where a key may be far too large for one task.

    Rows are windowed inside (key, bucket); ``bucket`` must grow with the first
    order column. The last value of each bucket is found by an aggregate, and a
    window over those few bucket rows hands it to the next bucket's first row.
    """
    b = df.withColumn("_b", bucket)
    inner = Window.partitionBy(key, "_b").orderBy(*order)
    rows = b.withColumn("_lag", F.lag(value).over(inner)).withColumn("_pos", F.row_number().over(inner))
    last = b.groupBy(key, "_b").agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    ends = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(key).orderBy("_b"))).drop("_last")
    return (rows.join(ends, [key, "_b"], "left")
            .withColumn(out, F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col("_lag")))
            .drop("_b", "_lag", "_pos", "_carry"))


#: Largest group whose pairs are proposed outright, nodes of a block, cells of a node's sketch, members of a list of a class, largest
#: group that is not wide.
LIGHT, BLOCK, CELLS, CHUNK, WIDE = 32, 1_000, 64, 500, 1_000


def shared_item_candidates(prefix: DataFrame, live: DataFrame, min_shared: int) -> DataFrame:
    """Distinct pairs ``a < b`` of (n, g, size) rows that meet in a group and may share ``min_shared`` groups of ``live``.

    Groups of up to ``LIGHT`` nodes propose their pairs: at most half as many as that for each row. In larger ones nodes are compared block
    by block inside the tasks, and only pairs whose upper bound reaches the threshold come out: a node's groups are counted
    in ``CELLS`` cells by hash, and two nodes share no more than the sum of the smaller counts.
    """
    near = prefix.where(F.col("size") <= LIGHT)
    pairs = near.select("g", F.col("n").alias("a")).join(near.select("g", F.col("n").alias("b")), "g").where("a < b").select("a", "b")
    wide = prefix.where(F.col("size") > LIGHT)
    own = wide.select("n").distinct()
    cells = live.join(own, "n", "left_semi").groupBy("n", F.pmod(F.xxhash64("g"), F.lit(CELLS)).alias("c")).agg(F.count("*").alias("m"))
    filled = cells.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("m"))  # at most CELLS entries
    sketch = filled.select("n", F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.least(F.coalesce(F.try_element_at("m", c.cast("bigint")), F.lit(0)), F.lit(30_000)).cast("short")).alias("sketch"))
    many = F.ceil(F.col("size") / BLOCK)
    rows = wide.join(sketch, "n").withColumn("own", F.pmod(F.xxhash64("n"), many)).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    rows = rows.select("g", "n", "sketch", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("low"))

    def bounded(table: pa.Table) -> pa.Table:
        ids = table.column("n").combine_chunks()
        counts = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(ids), CELLS)
        low = table.column("low").to_numpy()
        same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(low), np.flatnonzero(~low))
        found = []
        for at in range(0, len(left), 64):  # a few megabytes at a time
            part = left[at : at + 64]
            bound = np.zeros((len(part), len(right)), np.int32)
            for c in range(CELLS):
                bound += np.minimum(counts[part, c][:, None], counts[right, c][None])
            x, y = np.nonzero(bound >= min_shared)
            p, q = ids.take(pa.array(part[x])), ids.take(pa.array(right[y]))
            found.append(pa.table({"a": pc.min_element_wise(p, q), "b": pc.max_element_wise(p, q)}).filter(pc.less(part[x], right[y]) if same else pc.not_equal(p, q)))
        return pa.concat_tables(found) if found else pa.table({"a": pa.array([], kind), "b": pa.array([], kind)})

    kind = to_arrow_type(prefix.schema["n"].dataType)
    out = StructType([StructField("a", prefix.schema["n"].dataType), StructField("b", prefix.schema["n"].dataType)])
    return pairs.unionAll(rows.groupBy("g", "lo", "hi").applyInArrow(bounded, out)).distinct()


def folded(live: DataFrame) -> DataFrame:
    """(n, rep, k): nodes of exactly the same groups are one class, named after its smallest node; ``k`` is the number of groups.

    Equal sets are told by their size and two 64-bit sums (exclusive or) of hashes, which combine map-side however many groups a node has.
    """
    key = ["k", "x", "y"]
    sets = live.groupBy("n").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64(F.lit(1), "g")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "g")).alias("y"))
    return sets.join(sets.groupBy(*key).agg(F.min("n").alias("rep")), key).select("n", "rep", "k")


def unfolded(classes: DataFrame, counts: DataFrame, apart: DataFrame | None) -> DataFrame:
    """(a, b, shared) of nodes from (n, rep) and the counts between representatives, ``a = b`` for pairs within a class.

    Members meet in lists of up to ``CHUNK``, so a row of a pair of lists is short beside the pairs it stands for. Of two nodes
    of ``apart`` no pair comes out.
    """
    rows = classes.select("n", "rep", F.lit(False).alias("barred"))
    if apart is not None:
        marks = apart.select(F.col("id").alias("n"), F.lit(True).alias("_m")).distinct()
        rows = classes.join(marks, "n", "left").select("n", "rep", F.coalesce("_m", F.lit(False)).alias("barred"))
    many = rows.groupBy("rep", "barred").agg(F.ceil(F.count("*") / CHUNK).alias("many"))
    dealt = rows.join(many, ["rep", "barred"]).withColumn("chunk", F.pmod(F.xxhash64("n"), F.col("many")))
    lists = cut_lineage(dealt.groupBy("rep", "barred", "chunk").agg(F.collect_list("n").alias("ns")))  # about CHUNK each
    own = F.struct("barred", "chunk")
    left = lists.select(F.col("rep").alias("a"), F.col("ns").alias("xs"), own.alias("i"))
    right = lists.select(F.col("rep").alias("b"), F.col("ns").alias("ys"), own.alias("j"))
    met = counts.join(left, "a").join(right, "b").where("(a <> b OR i <= j) AND NOT (i.barred AND j.barred)")
    met = met.select("shared", "xs", "ys", (F.col("a") == F.col("b")).alias("within"), F.expr("a = b AND i = j").alias("same")).repartition(F.xxhash64("xs", "ys"))
    pairs = met.withColumn("x", F.explode("xs")).select("shared", "same", "x", F.explode("ys").alias("y")).where("NOT same OR x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def near_counts(rows: DataFrame, min_shared: int, apart: DataFrame | None) -> DataFrame:
    """(a, b, shared), ``a < b``: pairs that share at least ``min_shared`` groups of ``rows`` (n, g, wide), one of them not wide.

    Nodes of the same groups are counted once, through a representative, and come back as pairs at the end: nothing before the answer
    grows with the square of the nodes where the groups are few.

    Two nodes that share ``t`` groups must share one among each node's ``n - t + 1`` smallest groups, because at most ``t - 1`` shared
    groups can lie outside that prefix. Groups are ordered by size, so the largest ones tend to fall outside the
    prefixes. Pairs of small groups, and those of large ones whose upper bound reaches the threshold, are then counted over the full
    log by two equi-joins. Wide groups come last in the order: a pair that meets first in such a one shares no other.
    """
    classes = cut_lineage(folded(rows).where(F.col("k") >= min_shared))
    within = classes.groupBy("rep").agg(F.count("*").alias("m"), F.first("k").alias("shared")).where("m > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), "shared")

    reps = rows.join(classes.where("n = rep").select("n"), "n", "left_semi")
    sizes = reps.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") >= 2)
    live = cut_lineage(reps.join(sizes, "g"))
    per_node = live.groupBy("n").agg(F.count("*").alias("k")).where(F.col("k") >= min_shared)
    live = live.join(per_node, "n")
    # the t - 1 largest groups of a node are outside its prefix; finding those is a rank limit
    prefix = live
    if min_shared > 1:
        largest = top_per_group(live.select("n", "g", "size", "wide"), ["n"], [F.desc("wide"), F.desc("size"), F.desc("g")], min_shared - 1)
        prefix = live.join(largest.select("n", "g"), ["n", "g"], "left_anti")
    cand = shared_item_candidates(prefix.where("NOT wide"), live, min_shared)
    # count over the shorter history of the two, so that a node seen everywhere is not expanded per partner
    ka = per_node.select(F.col("n").alias("a"), F.col("k").alias("ka"))
    kb = per_node.select(F.col("n").alias("b"), F.col("k").alias("kb"))
    a_first = F.col("ka") <= F.col("kb")
    sided = cand.join(ka, "a").join(kb, "b").select(
        "a", "b", F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("n"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("m"))
    slim = live.select("n", "g")
    hits = sided.join(slim, "n").join(slim.withColumnRenamed("n", "m"), ["m", "g"], "left_semi")
    between = hits.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    return unfolded(classes, between.unionAll(within), apart)


def shared_item_parts(log: DataFrame, min_shared: int, apart: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Of a log of (n, g): the counts (a, b, shared) of pairs that share a group which is not wide, and (n, s), the wide groups of each
    node that has ``min_shared`` of them, as numbers. Either is None where there is no such group.

    Groups of more than ``WIDE`` nodes are wide, if comparing all of their nodes costs less than doing so group by group.
    """
    pairs = log.where("n IS NOT NULL AND g IS NOT NULL").distinct()
    sizes = pairs.groupBy("g").agg(F.count("*").alias("nodes")).where("nodes >= 2")
    every = cut_lineage(pairs.join(sizes, "g"))  # narrow, and read several times below
    large = every.where(F.col("nodes") > WIDE)
    many, work = large.agg(F.count_distinct("n"), F.sum("nodes")).first()
    if not work or many * many > CELLS * work:
        return near_counts(every.select("n", "g", F.lit(False).alias("wide")), min_shared, apart), None
    numbers = numbered(large.select("g").distinct(), "g", "i").select("g", "i")
    sets = large.join(numbers, "g").groupBy("n").agg(F.collect_list("i").alias("s")).where(F.size("s") >= min_shared)
    small = every.where(F.col("nodes") <= WIDE).select("n").distinct()
    if small.isEmpty():
        return None, sets
    return near_counts(every.select("n", "g", (F.col("nodes") > WIDE).alias("wide")).join(small, "n", "left_semi"), min_shared, apart), sets


def shared_item_sums(logs: list[DataFrame], min_shared: int, apart: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, mark): node pairs ``a < b`` that meet in at least ``min_shared`` groups of a log of (n, g), with the count; exact.

    Counts that reach the threshold are summed over the logs. Two nodes of ``apart`` (id) are no pair. ``marks`` (a, b, mark), ``a < b``:
    a pair that comes out gets its smallest mark. Pairs that meet in wide groups only may be far more than rows; they are counted, summed
    and marked in one place (``pairs_in_cells``) and never shuffled.
    """
    if apart is not None:
        apart = cut_lineage(apart.select("id").distinct())
    parts = [shared_item_parts(log.select("n", "g"), min_shared, apart) for log in logs]
    node = logs[0].schema["n"].dataType
    spark, kinds = logs[0].sparkSession, range(len(logs))
    marks = marks if marks is not None else spark.createDataFrame([], StructType([StructField("a", node), StructField("b", node), StructField("mark", LongType())]))
    known = marks.select("a", "b", *[F.lit(None).cast("bigint").alias(f"c{i}") for i in kinds], "mark")
    for i, (near, _) in enumerate(parts):
        if near is not None:
            known = known.unionByName(near.select("a", "b", F.col("shared").alias(f"c{i}")), allowMissingColumns=True)
    known = known.groupBy("a", "b").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in kinds], F.min("mark").alias("mark"))
    if not any(sets is not None for _, sets in parts):
        counts = [F.col(f"c{i}") for i in kinds]
        return known.where(F.coalesce(*counts).isNotNull()).select("a", "b", sum(F.coalesce(c, F.lit(0).cast("bigint")) for c in counts).alias("shared"), "mark")
    nodes = None
    for i, (_, sets) in enumerate(parts):
        if sets is not None:
            own = sets.select("n", *[(F.col("s") if i == j else F.lit(None).cast("array<bigint>")).alias(f"s{j}") for j in kinds])
            nodes = own if nodes is None else nodes.unionAll(own)
    nodes = nodes.groupBy("n").agg(*[F.first(f"s{i}", ignorenulls=True).alias(f"s{i}") for i in kinds])
    barred = F.lit(False)
    if apart is not None:
        nodes, barred = nodes.join(apart.select(F.col("id").alias("n"), F.lit(True).alias("_m")), "n", "left"), F.coalesce("_m", F.lit(False))
    return pairs_in_cells(nodes.withColumn("barred", barred).drop("_m"), known, len(logs), min_shared)


def shared_item_counts(log: DataFrame, node: str, group: str, min_shared: int, apart: DataFrame | None = None) -> DataFrame:
    """Node pairs ``a < b`` that meet in at least ``min_shared`` groups, with the count; exact. Two nodes of ``apart`` (id) are no pair."""
    return shared_item_sums([log.select(F.col(node).alias("n"), F.col(group).alias("g"))], min_shared, apart).select("a", "b", "shared")


def held(df: DataFrame, most: int) -> DataFrame:
    """A result that later steps shall not compute again: up to ``most`` rows as a local relation, else in a checkpoint.

    Spark knows the size of either and joins accordingly; a batch of any size works.
    """
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return cut_lineage(df)
    return df.sparkSession.createDataFrame(rows, df.schema)


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """1-based position in the order of a key, without one task sorting all rows.

    Spark samples the key's ranges, so sparse and dense ids are dealt alike. Rows are ranked inside their range; the sizes of
    the ranges, one figure for each shuffle partition, give the offsets.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, key).withColumn("_b", F.spark_partition_id()))
    offsets, total = [], 0
    for b, n in sorted(ranged.groupBy("_b").count().collect()):
        offsets.append((b, total))
        total += n
    before = spark.createDataFrame(offsets, "_b int, _off bigint")
    inner = ranged.withColumn("_pos", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    return inner.join(before, "_b").withColumn(out, F.col("_off") + F.col("_pos")).drop("_b", "_pos", "_off")


def weighted_percentiles(folded: DataFrame, key: str, value: str, weight: str, ps: list[float]) -> DataFrame:
    """(key, p, at): interpolated percentiles of a key's values, each of which stands for ``weight`` rows; exact.

    A selection by range counts: values are dealt out by ranges of (key, value), the weights of the ranges tell in which one a wanted
    rank lies, and only there it is looked up. However many values a key has, no task holds them all. Fold equal values before.
    """
    parts = int(folded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(folded.select(key, value, weight).repartitionByRange(parts, key, value).withColumn("_r", F.spark_partition_id()))
    sums = ranged.groupBy(key, "_r").agg(F.sum(weight).alias("_s"))
    ahead = Window.partitionBy(key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = sums.select(key, "_r", "_s", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))
    rank = F.col("p") * (F.col("_n") - 1)
    wanted = sums.groupBy(key).agg(F.sum("_s").alias("_n")).withColumn("p", F.explode(F.lit([float(p) for p in ps]))).select(
        key, "p", F.floor(rank).alias("_lo"), F.ceil(rank).alias("_hi"), (rank - F.floor(rank)).alias("_part"))
    asked = before.join(wanted, key).where((F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_s") > F.col("_lo")))
    inside = Window.partitionBy("_r", key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn("_upto", F.sum(weight).over(inside)).join(asked, [key, "_r"])
    end, start = F.col("_before") + F.col("_upto"), F.col("_before") + F.col("_upto") - F.col(weight)
    held = lambda r: F.max(F.when((start <= F.col(r)) & (end > F.col(r)), F.col(value)))
    found = rows.groupBy(key, "p", "_part").agg(held("_lo").alias("_a"), held("_hi").alias("_b"))
    return found.select(key, "p", (F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))).alias("at"))
