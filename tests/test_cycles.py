"""Batch reachability by contraction and two-sided search, against a plain closure."""

import random

import pytest

from loomgraph.operators import cycles as C
from loomgraph.operators import tasks as T


def closure(edges, pairs):
    after = {}
    for u, v in edges:
        after.setdefault(u, set()).add(v)
    got = set()
    for x, y in pairs:
        seen, todo = {x}, [x]
        while todo:
            for n in after.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        if y in seen:
            got.add((x, y))
    return got


def pairs_of(spark, edges, pairs):
    e = spark.createDataFrame(edges, "u bigint, v bigint")
    p = spark.createDataFrame(pairs, "x bigint, y bigint")
    return {tuple(r) for r in C.reachable_pairs(e, p).collect()}


@pytest.mark.parametrize("seed", range(1))
def test_reachable_pairs_of_mixed_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(i, i + 1) for i in range(60) if i % 23]  # chains
    edges += [(100 + i, 100 + (i + 1) % 7) for i in range(7)]  # a ring alone
    edges += [(200 + i, 200 + (i + 1) % 5) for i in range(5)] + [(202, 30), (10, 200)]  # a ring with ways in and out
    edges += [(300 + i // 2, 300 + i) for i in range(1, 40)]  # a tree
    edges += [(rnd.randrange(400, 440), rnd.randrange(400, 440)) for _ in range(45 + 10 * seed)]
    edges += [(500 + i, 501 + i) for i in range(6)] + [(506, 502), (506, 520), (7, 7), (None, 3), (3, None)]  # a way back into a run
    nodes = sorted({n for e in edges for n in e if n is not None}) + [999]
    pairs = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(300)] + [(505, 503), (503, 505), (520, 502), (101, 105), (7, 7), (999, 999), (None, 1), (505, 503)]
    assert pairs_of(spark, edges, pairs) == closure([e for e in edges if None not in e], {p for p in pairs if None not in p})


def test_a_long_chain_with_many_questions(spark, monkeypatch):
    rows = []
    cut = C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: (lambda out: (rows.append(out.count()), out)[1])(cut(df)))
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(3000)]
    pairs = [(rnd.randrange(3001), rnd.randrange(3001)) for _ in range(1000)]
    assert pairs_of(spark, edges, pairs) == {(x, y) for x, y in pairs if x <= y}
    assert max(rows) <= 3001 and len(rows) < 40  # no row per question and task, and rounds by the logarithm


def test_a_tree_moves_questions_to_its_root(spark, monkeypatch):
    monkeypatch.setattr(C, "met", lambda *a: 1 / 0)  # nothing is left to search
    edges = [(i // 2, i) for i in range(2, 500)]
    rnd = random.Random(2)
    pairs = [(i, i + i % 5) for i in range(1, 500)] + [(rnd.randrange(1, 20), rnd.randrange(1, 500)) for _ in range(200)] + [(0, 4), (4, 900)]
    assert pairs_of(spark, edges, pairs) == closure(edges, pairs)
    turned = [(v, u) for u, v in edges]
    assert pairs_of(spark, turned, [(y, x) for x, y in pairs]) == closure(turned, [(y, x) for x, y in pairs])


def test_proposed_dependencies(spark):
    deps = spark.createDataFrame([(2, 1), (3, 2), (4, 2)], "task_id bigint, blocked_by bigint")
    asked = spark.createDataFrame([(1, 4, "a"), (4, 3, "b"), (5, 5, "c"), (1, 3, "d"), (3, 1, "e"), (None, 1, "f")], "task_id bigint, blocked_by bigint, note string")
    assert {r["note"] for r in T.cycle_edges(deps, asked).collect()} == {"a", "c", "d"}
    assert T.cycle_edges(deps.limit(0), asked).select("note").collect() == [("c",)]
    assert T.cycle_edges(deps, asked.limit(0)).collect() == []
