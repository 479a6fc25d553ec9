"""Loops end at their fixed point, whatever the depth; thresholds lose no pair; odd inputs give defined results."""

from loomgraph.operators import graph as G
from loomgraph.operators import mining as M
from loomgraph.operators import quality as Q
from loomgraph.operators import scale as S
from loomgraph.operators import tasks as T
from loomgraph.operators import traits as TR

EDGE = "id bigint, source_id bigint, target_id bigint, relation string, strength double, status string, generation_method string"


def test_dependents_of_a_long_chain(spark):
    deps = spark.createDataFrame([(i + 1, i) for i in range(300)], "task_id bigint, blocked_by bigint")
    start = spark.createDataFrame([(0, 0)], "root bigint, id bigint")
    assert T.dependents(deps, start, hops_per_round=30).count() == 301
    asked = spark.createDataFrame([(0, 300), (300, 0), (5, 400)], "task_id bigint, blocked_by bigint")
    assert [(r[0], r[1]) for r in T.cycle_edges(deps, asked).collect()] == [(0, 300)]


def test_shortest_path_of_twenty_hops(spark):
    edges = spark.createDataFrame([(i, i, i + 1, "led_to", 0.5, "active", "") for i in range(20)], EDGE)
    tree = {r["id"]: (r["hop"], r["parent"]) for r in G.shortest_paths(edges, 0).collect()}
    assert tree == {i: (i, i - 1 if i else None) for i in range(21)}
    assert {r["id"] for r in G.shortest_paths(edges, 0, target=4).collect()} == set(range(5))


def test_components_of_a_long_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(900, 901)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in G.components(pairs).collect()}
    assert all(got[i] == 0 for i in range(151)) and got[901] == 900


def test_similar_sets_of_six_to_eight(spark):
    words = list("abcdefgh")
    rows = [(n, "T", "p", "active", words[:n]) for n in (5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "id bigint, type string, project string, status string, key_concepts array<string>")
    got = {(r["a"], r["b"]) for r in M.similar_pairs(df, 0.17).collect()}
    assert got == {(5, 6), (6, 7), (7, 8)}
    assert {(r["a"], r["b"]) for r in M.similar_pairs(df).collect()} == {(6, 7), (7, 8)}


def test_numbering_of_sparse_ids(spark):
    ids = [i * 10**12 + 7 for i in range(50)] + [3, 4, 5]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert {r["id"]: r["pos"] for r in S.numbered(df, "id", "pos").collect()} == {i: n + 1 for n, i in enumerate(sorted(ids))}
    assert S.numbered(df.limit(0), "id", "pos").collect() == []


def test_held_goes_on_beyond_its_bound(spark):
    assert S.held(spark.range(50), 10).count() == 50 and S.held(spark.range(5), 10).count() == 5


def test_review_without_marks_and_with_marks(spark):
    traits = spark.createDataFrame([("t12", "pending"), ("t13", "archived"), ("t2", "pending")], "id string, status string")
    none = spark.createDataFrame([], "prefix string, mark string")
    assert TR.apply_review(traits, none).collect() == []
    marks = spark.createDataFrame([("t1", "x"), ("t2", "r")], "prefix string, mark string")
    assert {(r["id"], r["status"]) for r in TR.apply_review(traits, marks).collect()} == {("t12", "verified"), ("t2", "archived")}


def test_a_bad_trait_origin_is_no_error(spark):
    traits = spark.createDataFrame([("a", '{"migrated_from_node_id": "x1"}'), ("b", '{"migrated_from_node_id": 4}')], "id string, metadata string")
    assert {r["trait_id"]: r["target_id"] for r in TR.origin(traits).collect()} == {"a": None, "b": 4}


def test_daily_counts_take_active_nodes(spark):
    rows = [(1, "active", "2024-04-28 00:00:00"), (2, "archived", "2024-04-28 00:00:00"), (3, "active", "2024-04-24 00:00:00"), (4, "active", "2024-04-24 00:00:01")]
    df = spark.createDataFrame(rows, "id bigint, status string, at string").selectExpr("id", "status", "cast(at as timestamp_ntz) as created_at")
    assert {(r["day"], r["n"]) for r in Q.daily_counts(df, "2024-05-01 00:00:00").collect()} == {("2024-04-28", 1), ("2024-04-24", 1)}
