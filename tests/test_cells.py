"""Pairs of nodes in large groups: the whole answer, and none of its pairs in a shuffle."""

import itertools
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cells, scale
from loomgraph.operators import mining as M


def all_pairs(rows, least):
    groups, found = {}, {}
    for n, g in {r for r in rows if None not in r}:
        groups.setdefault(g, []).append(n)
    for members in groups.values():
        for p in itertools.combinations(sorted(members), 2):
            found[p] = found.get(p, 0) + 1
    return {p: c for p, c in found.items() if c >= least}


@pytest.mark.parametrize("name, kind", [(int, "bigint"), (lambda n: f"n{n}", "string")])
def test_sums_of_small_and_large_groups_equal_all_pairs(spark, monkeypatch, name, kind):
    """Groups of a few and of most nodes, two logs, repeated rows, nulls, nodes that are no pair, several marks of a pair; many cells."""
    monkeypatch.setattr(scale, "WIDE", 30)
    monkeypatch.setattr(cells, "GIVEN", 20)  # more blocks than nodes ask for
    monkeypatch.setattr(cells, "PARTS", 8)
    rnd = random.Random(3)
    first = [(name(rnd.randrange(100)), f"g{int(rnd.random() ** 2 * 12)}") for _ in range(600)] + [(name(rnd.randrange(130)), f"l{rnd.randrange(90)}") for _ in range(500)]
    second = [(name(rnd.randrange(90)), f"h{rnd.randrange(80)}" if rnd.random() < 0.2 else f"w{rnd.randrange(70)}") for _ in range(3_000)]  # over 64 large ones
    logs = [rows + rows[:50] + [(None, "g0"), (None, "g1"), (name(5), None), (name(6), None)] for rows in (first, second)]
    apart = {name(n) for n in rnd.sample(range(130), 50)}
    marks = [(*sorted((name(x), name(y))), 1000 * x + y + k) for x, y in itertools.combinations(range(0, 130, 3), 2) for k in (1, 0)]
    want = {}
    for rows in logs:
        for p, c in all_pairs(rows, 3).items():
            want[p] = want.get(p, 0) + c
    smallest = {}
    for x, y, k in marks:
        smallest[x, y] = min(k, smallest.get((x, y), k))
    want = sorted((*p, c, smallest.get(p, -1)) for p, c in want.items() if not set(p) <= apart)
    frames = [spark.createDataFrame(rows, f"n {kind}, g string") for rows in logs]
    got = scale.shared_item_sums(frames, 3, spark.createDataFrame([(n,) for n in apart], f"id {kind}"), spark.createDataFrame(marks, f"a {kind}, b {kind}, mark bigint"))
    assert sorted((r["a"], r["b"], r["shared"], -1 if r["mark"] is None else r["mark"]) for r in got.collect()) == want


def test_pairs_of_large_sessions_are_not_shuffled(spark):
    """1,400 nodes in sessions of over 1,000, nearly all of them pairs: they come out where they are found, summed and with their edges."""
    rnd = random.Random(8)
    seen = np.array([[rnd.random() < 0.85 for _ in range(6)] for _ in range(1_400)])
    log = [(n, None, "q", date(2024, 1, 1 + d)) for n, d in np.argwhere(seen).tolist()]
    log += [(n, f"r{s}", "q", date(2024, 1, 1)) for s in range(3) for n in (1, 2, 3)]  # those three once more, in sessions of their own
    edges = [(10 + i, s, t, "co_retrieved", "active") for i, (s, t) in enumerate([(1, 2), (1, 2), (4, 3), (7, 8)])]
    edges += [(100 + i, 0, 2_000 + i, "led_to", "active") for i in range(60)] + [(200 + i, 5, 3_000 + i, "led_to", "active") for i in range(60)]
    found = M.co_retrieval(spark.createDataFrame(log, "node_id bigint, recall_id string, query string, day date"),
                           spark.createDataFrame(edges, "id bigint, source_id bigint, target_id bigint, relation string, status string"), min_count=3, hub_percentile=99, legacy_stamp="day")
    above, made, _ = found._jdf.queryExecution().executedPlan().toString().partition("FlatMapGroupsInArrow")
    assert made and "Exchange" not in above and "Join" not in above
    shared = seen.astype(int) @ seen.T
    shared = np.where(shared >= 3, shared, 0)
    for x, y in ((1, 2), (1, 3), (2, 3)):
        shared[x, y] += 3
    shared[0, 5] = 0  # two hubs
    x, y = np.nonzero(np.triu(shared, 1))
    got = np.array([tuple(r) for r in found.select("source_id", "target_id", "co_count").orderBy("source_id", "target_id").collect()])
    assert np.array_equal(got, np.stack([x, y, shared[x, y]], axis=1)) and len(got) > 500_000
    updates = {(r["source_id"], r["target_id"]): (r["edge_id"], r["action"]) for r in found.where(F.col("edge_id").isNotNull()).collect()}
    assert updates == {p: (i, "update") for p, i in (((1, 2), 10), ((7, 8), 13)) if shared[p]} and (1, 2) in updates
