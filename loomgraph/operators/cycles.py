"""Would a dependency close a cycle? Batch reachability by contraction, then search from both sides.

Where only one way leads to a task, a question that ends there ends as well at the task before: such tasks form trees, in which a question
is answered by depth, or moves to the root of its tree, in rounds by the logarithm of the depth; the same from the other end. What is
left after that is folded. A run of tasks with one way on and one way in is folded to one node, by pointer jumping, so that a long chain costs rounds in proportion
to the logarithm of its length and each task a row per round. Questions inside a run are answered by the places in it; all others
move on to the runs of their two tasks. Runs that no question can pass (nothing leads into them and none starts there, or nothing
leads on and none ends there) are peeled off; both steps alternate while they take off a fifth of the ways. What remains is searched from both ends,
the smaller frontier first, and a question leaves as soon as it is answered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage


#: Ways from which on a further round of folding would cost more than it saves.
SMALL = 20_000


def folded(edges: DataFrame) -> DataFrame | None:
    """(id, run, place, ring) for every node of `edges` (u, v) in a run of several; none if there is no such run. A run is named by
    its first node, a ring (all of whose nodes follow each other) by its smallest."""
    ways = edges.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("n"), F.min("v").alias("only")).where("n = 1")
    ins = edges.groupBy(F.col("v").alias("only")).agg(F.count("*").alias("m")).where("m = 1")
    links = cut_lineage(ways.join(ins, "only").select(F.col("only").alias("id"), F.col("id").alias("at")))  # (id, the one before)
    many = links.count()
    if not many:
        return None
    firsts = links.select(F.col("at").alias("id")).distinct().join(links.select("id"), "id", "left_anti")
    rows = links.select("id", "at", F.lit(1).cast("bigint").alias("place"), F.least("id", "at").alias("low"), F.lit(False).alias("done"))
    rows = cut_lineage(rows.unionAll(firsts.select("id", F.col("id").alias("at"), F.lit(0).cast("bigint"), F.col("id"), F.lit(True))))
    for _ in range(math.ceil(math.log2(many + 1)) + 1):
        ahead = rows.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("place").alias("place2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        step = rows.where("not done").join(ahead, "at").select("id", F.col("at2").alias("at"), (F.col("place") + F.col("place2")).alias("place"),
                                                               F.least("low", "low2").alias("low"), F.col("done2").alias("done"))
        rows = cut_lineage(rows.where("done").unionAll(step))
        if rows.where("not done").isEmpty():
            break
    # what has found no first node after that many doublings runs in a ring
    return rows.select("id", F.when(F.col("done"), F.col("at")).otherwise(F.col("low")).alias("run"), "place", (~F.col("done")).alias("ring"))


def lifted(edges: DataFrame, open_: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Questions (a, b, x, y), x <> y, whose y moves back along the only ways in: (those with x on that path, the others).

    Nodes with one way in form trees below nodes with none or several. ``levels[j]`` holds the node 2^j steps up from each, or the root.
    A question is answered if x is the node as many steps above y as their depths differ; else every way to y comes by the root, where it
    ends from now on. What is below a ring has no root and stays.
    """
    ins = edges.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("m"), F.min("u").alias("at")).where("m = 1")
    links = ins.join(ins.select(F.col("id").alias("at"), F.lit(True).alias("inner")), "at", "left")
    rows = cut_lineage(links.select("id", "at", F.lit(1).cast("bigint").alias("place"), F.col("inner").isNull().alias("done")))  # (id, node above, steps)
    many, levels = rows.count(), [rows]
    if not many:
        return None, open_
    for _ in range(math.ceil(math.log2(many + 1)) + 1):
        if rows.where("not done").isEmpty():
            break
        ahead = rows.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("place").alias("place2"), F.col("done").alias("done2"))
        step = rows.where("not done").join(ahead, "at").select("id", F.col("at2").alias("at"), (F.col("place") + F.col("place2")).alias("place"), F.col("done2").alias("done"))
        rows = cut_lineage(rows.where("done").unionAll(step))
        levels.append(rows)
    side = lambda c: rows.where("done").select(F.col("id").alias(c), F.col("at").alias(f"{c}_root"), F.col("place").alias(f"{c}_depth"))
    at = open_.join(side("x"), "x", "left").join(side("y"), "y", "left").select(
        "a", "b", "x", "y", F.coalesce("x_root", "x").alias("top"), F.coalesce("y_root", "y").alias("root"),
        (F.coalesce("y_depth", F.lit(0)) - F.coalesce("x_depth", F.lit(0))).alias("steps"), F.col("y").alias("now"))
    at = cut_lineage(at)
    walk = cut_lineage(at.where("top = root AND steps > 0").select("a", "b", "x", "now", "steps"))
    left = walk.agg(F.max("steps")).first()[0] or 0
    for j, level in enumerate(levels[: left.bit_length()]):
        bit = F.col("steps").bitwiseAND(F.lit(1 << j)) != 0
        jump = walk.where(bit).join(level.select(F.col("id").alias("now"), "at"), "now").select("a", "b", "x", F.col("at").alias("now"), "steps")
        walk = cut_lineage(walk.where(~bit).unionByName(jump))
    met_ = walk.where("x = now").select("a", "b")
    rest = at.join(met_, ["a", "b"], "left_anti").select("a", "b", "x", F.col("root").alias("y"))
    return met_.select(F.col("a").alias("x"), F.col("b").alias("y")), rest


def reachable_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (x, y) with a way from x to y along ``edges`` (u, v); a node reaches itself."""
    asked = pairs.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct()
    answered = [asked.where("x = y")]
    edges = cut_lineage(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").distinct())
    # a question has at least one step to go: (a, b) as asked, from x to y as they are now
    open_ = cut_lineage(asked.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"), "x", "y"))
    for u, v, x, y in (("u", "v", "x", "y"), ("v", "u", "y", "x")):  # from the ends, then from the starts
        turned = open_.select("a", "b", F.col(x).alias("x"), F.col(y).alias("y"))
        hit, turned = lifted(edges.select(F.col(u).alias("u"), F.col(v).alias("v")), turned)
        if hit is not None:
            answered.append(hit)
        open_ = turned.select("a", "b", F.col(x).alias("x"), F.col(y).alias("y"))
        open_ = cut_lineage(open_.join(edges.select(F.col("u").alias("x")).distinct(), "x", "left_semi").join(edges.select(F.col("v").alias("y")).distinct(), "y", "left_semi"))
        if open_.isEmpty():
            return united(answered)
    before = edges.count()
    while True:
        ends = open_.select(F.col("x").alias("id"), F.lit(True).alias("start")).union(open_.select("y", F.lit(False))).distinct()
        starts, stops = ends.where("start").select("id"), ends.where("not start").select("id")
        # peel: where nothing comes in, only starts matter; where nothing goes on, only ends
        tails = edges.select(F.col("u").alias("id")).unionByName(stops).distinct()
        heads = edges.select(F.col("v").alias("id")).unionByName(starts).distinct()
        edges = cut_lineage(edges.join(tails.withColumnRenamed("id", "v"), "v", "left_semi").join(heads.withColumnRenamed("id", "u"), "u", "left_semi"))
        runs = folded(edges)
        if runs is not None:
            side = lambda c: runs.select(F.col("id").alias(c), F.col("run").alias(f"{c}_run"), F.col("place").alias(f"{c}_place"), F.col("ring").alias(f"{c}_ring"))
            at = open_.join(side("x"), "x", "left").join(side("y"), "y", "left").select(
                "a", "b", F.coalesce("x_run", "x").alias("x"), F.coalesce("y_run", "y").alias("y"), F.coalesce("x_place", F.lit(0)).alias("p"),
                F.coalesce("y_place", F.lit(0)).alias("q"), F.coalesce("x_ring", F.lit(False)).alias("ring"))
            at = cut_lineage(at)
            inside = (F.col("x") == F.col("y")) & (F.col("ring") | (F.col("p") < F.col("q")))
            answered.append(at.where(inside).select(F.col("a").alias("x"), F.col("b").alias("y")))
            open_ = at.where(~inside).select("a", "b", "x", "y")
            edges = edges.join(side("u"), "u", "left").join(side("v"), "v", "left")
            mapped = cut_lineage(edges.select(F.coalesce("u_run", "u").alias("u"), F.coalesce("v_run", "v").alias("v"), (F.col("v_place") != F.col("u_place") + 1).alias("back")))
            # a way from the last node of a run back into it leads from the run to itself
            loops = mapped.where("u = v AND back").select(F.col("u").alias("x")).distinct()
            again = open_.where("x = y").join(loops, "x", "left_semi").select("a", "b")
            answered.append(again.select(F.col("a").alias("x"), F.col("b").alias("y")))
            open_ = open_.join(again, ["a", "b"], "left_anti")
            edges = cut_lineage(mapped.where("u <> v").select("u", "v").distinct())
        open_ = open_.join(edges.select(F.col("u").alias("x")).distinct(), "x", "left_semi").join(edges.select(F.col("v").alias("y")).distinct(), "y", "left_semi")
        open_ = cut_lineage(open_)
        size = edges.count()
        if size <= SMALL or 5 * size > 4 * before or open_.isEmpty():
            break  # little left, or little gained
        before = size
    if not open_.isEmpty():
        answered.append(met(edges, open_))
    return united(answered)


def united(answered: list[DataFrame]) -> DataFrame:
    out = answered[0]
    for more in answered[1:]:
        out = out.unionByName(more)
    return out.distinct()


def met(edges: DataFrame, open_: DataFrame, hops: int = 2) -> DataFrame:
    """Questions (a, b, x, y) with a way of at least one edge from x to y, as (x, y) = (a, b): both sides grow by turns, a few hops each."""
    ways = open_.select("x", "y").distinct()
    on = edges.select("u", "v")
    front = {"x": cut_lineage(ways.select("x").distinct().join(on, F.col("x") == F.col("u")).select("x", F.col("v").alias("id")).distinct()),
             "y": ways.select("y", F.col("y").alias("id")).distinct()}
    seen, found = dict(front), []
    hit = ways.join(seen["x"], "x").join(seen["y"], ["y", "id"]).select("x", "y").distinct()
    while True:
        found.append(cut_lineage(hit))
        ways = cut_lineage(ways.join(found[-1], ["x", "y"], "left_anti"))
        front = {s: front[s].join(ways.select(s).distinct(), s, "left_semi") for s in front}
        sizes = {s: front[s].count() for s in front}
        grown = min(sizes, key=sizes.get)  # a side that has nothing left has seen all it can reach
        if not sizes[grown]:
            break
        other, here, there = ("y", "u", "v") if grown == "x" else ("x", "v", "u")
        step, fresh = front[grown], None
        for _ in range(hops):
            step = step.join(on, F.col("id") == F.col(here)).select(grown, F.col(there).alias("id")).distinct()
            fresh = step if fresh is None else fresh.unionAll(step)
        front[grown] = cut_lineage(fresh.distinct().join(seen[grown], [grown, "id"], "left_anti"))
        seen[grown] = seen[grown].unionAll(front[grown])
        hit = ways.join(front[grown], grown).join(seen[other], [other, "id"]).select("x", "y").distinct()
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionAll(more)
    return open_.join(whole, ["x", "y"]).select(F.col("a").alias("x"), F.col("b").alias("y"))
