import random

from pyspark.sql import functions as F

from loomgraph.operators import lifecycle as L

AS_OF = "2024-05-01 00:00:00"


def test_sprt_first_crossing_wins_and_needs_five(spark):
    cases = {"promote": [0.9] * 4 + [0.1] * 6, "reject": [0.1] * 2 + [0.9] * 8, "open": [0.9, 0.1] * 4}
    for want, history in cases.items():
        df = spark.createDataFrame([(history,)], "h array<double>")
        assert df.select(L.sprt_verdict(F.col("h"))).first()[0] == want
    assert spark.createDataFrame([([0.9] * 4,)], "h array<double>").select(L.sprt_verdict(F.col("h"))).first()[0] == "open"


def test_sprt_simulation_keeps_its_error_rates(spark):
    good = {r["verdict"]: r["rate"] for r in L.sprt_simulation(spark, 0.7, n_sim=2000).collect()}
    bad = {r["verdict"]: r["rate"] for r in L.sprt_simulation(spark, 0.3, n_sim=2000).collect()}
    assert good["promote"] > 0.7 and bad.get("promote", 0) < 0.08 and sum(good.values()) > 0.999


def test_decay_floor_and_unchanged(spark):
    df = spark.createDataFrame([(1, 1.0, None, "2024-04-21"), (2, 0.06, "2023-05-01", "2020-01-01"), (3, 0.04, None, "2023-01-01"),
                                (4, 0.5, "2024-05-01", "2020-01-01")], "id bigint, strength double, la string, ca string")
    df = df.select("id", "strength", F.lit("active").alias("status"), F.col("la").cast("timestamp_ntz").alias("last_activated"),
                   F.col("ca").cast("timestamp_ntz").alias("created_at"))
    got = {r["id"]: (r["new_strength"], r["outcome"]) for r in L.decay_edges(df, AS_OF).collect()}
    assert got == {1: (round(0.999 ** 10, 6), "decayed"), 2: (0.05, "floored"), 3: (0.04, "at_floor"), 4: (0.5, "unchanged")}


def sequential_prune(nodes, edges):
    deg, out = {}, {}
    for e in edges:
        deg[e[1]] = deg.get(e[1], 0) + 1
        deg[e[2]] = deg.get(e[2], 0) + 1
    for eid, s, t, weak in sorted(edges):
        if not weak:
            continue
        if deg[s] <= 1 or deg[t] <= 1:
            out[eid] = "guarded"
        elif nodes[s][0] == 0 or nodes[s][1] >= 2:
            out[eid] = "archive"
        else:
            out[eid] = "delete"
            deg[s] -= 1
            deg[t] -= 1
    return out


def test_applied_pruning_equals_the_ordered_fold(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        n = 14
        nodes = {i: (rnd.choice([0, 2, 2, 2]), rnd.choice([0, 1, 1, 2])) for i in range(n)}
        edges = [(i, rnd.randrange(n), rnd.randrange(n), rnd.random() < 0.85) for i in range(26)]
        nf = spark.createDataFrame([(i, t, ly) for i, (t, ly) in nodes.items()], "id bigint, tier int, layer int")
        ef = spark.createDataFrame([(i, s, t, 0.01 if w else 0.9, 0, "active", None) for i, s, t, w in edges],
                                   "id bigint, source_id bigint, target_id bigint, strength double, frequency int, status string, description string")
        got = {r["id"]: r["decision"] for r in L.edge_pruning_applied(nf, ef).collect()}
        assert got == sequential_prune(nodes, edges), seed


def test_growth_caps_and_null_quality(spark):
    df = spark.createDataFrame([(None, 50, 100, 9, True)], "q double, e int, v int, p int, c boolean")
    created = F.lit("2024-05-01").cast("timestamp_ntz")
    score = L.growth_score(F.col("q"), F.col("e"), F.col("v"), F.col("p"), created, F.col("c"), AS_OF)
    assert abs(df.select(score).first()[0] - (0.15 + 0.2 + 0.2 + 0.2 + 0.1 - 0.2)) < 1e-9


def test_hebbian_gains_and_cap(spark, graph):
    nodes, edges = graph
    edges = edges.withColumn("frequency", F.lit(1)).withColumn("description", F.lit("[]")).withColumn(
        "strength", F.when(F.col("id") == 10, 1.995).otherwise(F.col("strength")))
    res = spark.createDataFrame([(0, 1), (0, 2)], "qid bigint, id bigint")
    got = {r["id"]: (r["strength"], r["frequency"]) for r in L.hebbian_update(nodes, edges, res, AS_OF, "why").collect()}
    assert got[10] == (2.0, 2) and got[16] == (0.115, 2) and got[11] == (0.405, 2) and 15 not in got and 18 not in got


def test_permissions_and_hub_protection(spark):
    df = spark.createDataFrame([(0, False), (2, False), (3, True), (5, False), (None, False)], "layer int, hub boolean")
    ask = lambda op, who: [r[0] for r in df.select(L.permitted(F.col("layer"), op, who, F.col("hub"))).collect()]
    assert ask("write", "system:pruning") == [True, False, False, False, True]
    assert ask("write", "owner") == [True, True, False, True, True]
    assert ask("modify_content", "enrichment:E7") == [True, False, False, False, True]
    assert ask("read", "anyone") == [True] * 5


def test_mdl_gate_equals_pairwise_mean(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(6, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(6)], "id bigint, embedding array<double>")
    groups = spark.createDataFrame([(i, 0 if i < 5 else 1) for i in range(6)], "id bigint, group_id int")
    u = v[:5] / np.linalg.norm(v[:5], axis=1, keepdims=True)
    want = np.mean([u[i] @ u[j] for i in range(5) for j in range(i + 1, 5)])
    got = {r["group_id"]: r for r in L.mdl_gate(df, groups).collect()}
    assert abs(got[0]["avg_similarity"] - want) < 1e-5 and got[1]["passed"]
