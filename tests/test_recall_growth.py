"""A recall of a few requests touches only the edges and scores of its own nodes."""

from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import lifecycle as L


def test_traversal_writes_no_whole_graph(spark, graph, monkeypatch):
    nodes, edges = graph
    seeds = spark.createDataFrame([(0, 1, 1.0), (1, 3, 0.5)], "qid bigint, id bigint, c double")
    want = {tuple(r) for r in G.ucb_traverse(nodes, edges, seeds, graph=G.build_graph(nodes, edges)).collect()}
    monkeypatch.setattr(G, "build_graph", lambda *a: 1 / 0)
    assert {tuple(r) for r in G.ucb_traverse(nodes, edges, seeds).collect()} == want and want


def test_both_ends_from_one_read(spark, graph):
    _, edges = graph
    ends = G.endpoints(edges, "relation")
    assert "Union" not in ends._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in ends.where("edge_id IN (10, 14)").collect()]
    assert sorted(rows) == [(10, 1, 2, True, "led_to"), (10, 2, 1, False, "led_to"), (14, 5, 5, True, "supports")]


def test_histories_of_the_recalled_nodes(spark):
    log = spark.range(300).select("id", (F.col("id") % 3).alias("node_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), (F.col("id") / 300).alias("score"))
    whole = {tuple(r) for r in L.score_history(log).selectExpr("id", "to_json(history)").collect()}
    some = {tuple(r) for r in L.score_history(log, among=spark.createDataFrame([(1,), (1,), (9,)], "id bigint")).selectExpr("id", "to_json(history)").collect()}
    assert some == {r for r in whole if r[0] == 1} and some
