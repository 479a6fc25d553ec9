"""Pairs of nodes that share large groups, counted where two blocks of nodes meet: no pair is shuffled, and each comes out once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomgraph.session import cut_lineage

#: Nodes of a block; so many blocks at least, for the sake of tasks, if each has so many nodes; nodes of a block that are compared with the
#: other at a time; given pairs of a cell; partitions at most.
CELL, SPREAD, LEAST, ROWS, GIVEN, PARTS = 8_192, 8, 1_000, 64, 2_000_000, 4_000


def pairs_in_cells(nodes: DataFrame, given: DataFrame, kinds: int, min_shared: int) -> DataFrame:
    """(a, b, shared, mark), ``a < b``: the sums over the kinds of the counts that reach ``min_shared``.

    ``nodes`` (n, s0, s1, ..., barred) has a node's groups of each kind as distinct numbers, null or empty where it has none; two barred
    nodes are no pair. ``given`` (a, b, c0, c1, ..., mark) has each pair once: a count of a kind that is known from elsewhere and stands in
    place of that of the lists, and a mark for the pair if it comes out. Nodes are dealt to blocks by hash, and a cell is a pair of blocks:
    what is shuffled is each node once for every block, and the given pairs.
    """
    nodes, given = cut_lineage(nodes), cut_lineage(given)
    many, known = nodes.count(), given.count()
    blocks = max(1, math.ceil(many / CELL), min(SPREAD, math.ceil(many / LEAST)), math.ceil(math.sqrt(2 * known / GIVEN)))
    parts = min(PARTS, blocks * (blocks + 1) // 2)
    sets, counts = [f"s{i}" for i in range(kinds)], [f"c{i}" for i in range(kinds)]

    def ends(x, y):
        return F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")

    def block(column):
        return F.pmod(F.xxhash64(column), F.lit(blocks).cast("bigint"))

    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    dealt = nodes.withColumn("own", block("n")).withColumn("other", other)
    dealt = dealt.select(*ends("own", "other"), (F.col("own") <= F.col("other")).alias("low"), "n", *sets, "barred")
    rows = dealt.unionByName(given.select(*ends(block("a"), block("b")), "a", "b", *counts, "mark"), allowMissingColumns=True)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        same = table["lo"][0].as_py() == table["hi"][0].as_py()
        own = pc.is_valid(table["n"])
        both, rest = table.filter(own), table.filter(pc.invert(own))
        both = both.take(pc.sort_indices(both["n"]))  # within a block, the order of positions is that of the ids
        left, right = (both, both) if same else (both.filter(both["low"]), both.filter(pc.invert(both["low"])))
        ids = [side["n"].combine_chunks() for side in (left, right)]
        barred = [side["barred"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool) for side in (left, right)]
        a, b, marks = (rest[c].combine_chunks() for c in ("a", "b", "mark"))
        totals = [pc.fill_null(rest[c], 0).to_numpy() for c in counts]

        def batch(p: pa.Array, q: pa.Array, shared: np.ndarray, mark: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pc.min_element_wise(p, q), pc.max_element_wise(p, q), pa.array(shared, pa.int64()), mark], names=["a", "b", "shared", "mark"])

        def place(values: pa.Array, among: pa.Array) -> np.ndarray:
            return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)

        def planes(column: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """For 64 groups each, the most frequent first: bits of the left nodes, which right nodes have any, and their bits."""
            lists = [side[column].combine_chunks() for side in (left, right)]
            flat = [pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in lists]
            found, which, often = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
            rank = np.empty(len(found), np.int64)
            rank[np.argsort(-often, kind="stable")] = np.arange(len(found))
            bits = []
            for x, at in zip(lists, np.split(rank[which], [len(flat[0])]), strict=True):
                bits.append(np.zeros((-(-len(found) // 64), len(x)), np.uint64))
                np.bitwise_or.at(bits[-1], (at >> 6, pc.list_parent_indices(x).to_numpy()), np.uint64(1) << (at & 63).astype(np.uint64))
            return [(p, np.flatnonzero(q), q[np.flatnonzero(q)]) for p, q in zip(*bits, strict=True)]

        ax, by = place(a, ids[0]), place(b, ids[1])
        x, y = ax, by
        if not same:  # the smaller node of a pair may be in either block
            x, y = np.where(ax >= 0, ax, place(b, ids[0])), np.where(ax >= 0, by, place(a, ids[1]))
        inside, any_count = (x >= 0) & (y >= 0), sum(totals) > 0
        if (alone := np.flatnonzero(~inside & any_count)).size:
            yield batch(a.take(pa.array(alone)), b.take(pa.array(alone)), sum(totals)[alone], marks.take(pa.array(alone)))
        here = np.flatnonzero(inside)
        here = here[np.lexsort((y[here], x[here]))]
        x, y, totals = x[here], y[here], [t[here] for t in totals]

        kept, wide = [planes(s) for s in sets], len(right)
        for at in range(0, len(left), ROWS):  # a few megabytes at a time
            high = min(ROWS, len(left) - at)
            hits = []
            for kind in kept:
                met_in = None
                for p, some, q in kind:
                    p = p[at : at + high]
                    have = np.flatnonzero(p)
                    if not (have.size and some.size):
                        continue
                    n = np.bitwise_count(p[have][:, None] & q)
                    if have.size < high or some.size < wide:
                        met_in = np.zeros((high, wide), np.int32) if met_in is None else met_in
                        met_in[np.ix_(have, some)] += n
                    else:
                        met_in = n.astype(np.int32) if met_in is None else met_in + n
                flat = np.zeros(0, np.int32) if met_in is None else met_in.ravel()
                code = np.flatnonzero(flat >= min_shared)
                i, j = np.divmod(code, wide)
                fit = ~(barred[0][at + i] & barred[1][j])
                if same:
                    fit &= j > at + i
                hits.append((code[fit], flat[code[fit]]))
            lo, hi = np.searchsorted(x, (at, at + high))
            known = (x[lo:hi] - at) * wide + y[lo:hi]
            if len(hits) == 1 and lo == hi:
                codes, shared = hits[0]
            else:
                counted = [t[lo:hi] > 0 for t in totals]
                codes = np.unique(np.concatenate([c for c, _ in hits] + [known[c] for c in counted]))
                shared = np.zeros(len(codes), np.int64)
                for (code, n), t, c in zip(hits, totals, counted, strict=True):
                    of = np.zeros(len(codes), np.int64)
                    of[np.searchsorted(codes, code)] = n
                    of[np.searchsorted(codes, known[c])] = t[lo:hi][c]
                    shared += of
            if not codes.size:
                continue
            i, j = np.divmod(codes, wide)
            mark = pa.nulls(len(codes), marks.type)
            if lo < hi:
                row, to = np.full(len(codes), -1), np.minimum(np.searchsorted(codes, known), len(codes) - 1)
                out = codes[to] == known
                row[to[out]] = here[lo:hi][out]
                mark = marks.take(pa.array(row, mask=row < 0))
            yield batch(ids[0].take(pa.array(at + i)), ids[1].take(pa.array(j)), shared, mark)

    kind = nodes.schema["n"].dataType
    out = StructType([StructField("a", kind), StructField("b", kind), StructField("shared", LongType()), StructField("mark", given.schema["mark"].dataType)])
    return rows.repartition(parts, "lo", "hi").groupBy("lo", "hi").applyInArrow(met, out)
