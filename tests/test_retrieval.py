import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.functions import text as T
from loomgraph.functions import vector as V
from loomgraph.functions.vector import VectorQuery, search
from loomgraph.operators import retrieval as R


def test_particle_stripping_both_forms(spark):
    words = ["시스템에서", "나는", "설계를", "이", "원칙", "학교에는", "memory"]
    want = ["시스템", "나는", "설계", "이", "원칙", "학교", "memory"]
    assert [T.strip_particle(w) for w in words] == want
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(T.strip_particle_column(F.col("w"))).collect()] == want


def test_query_helpers():
    assert T.query_terms("The 'Plan', the plan! a") == ["the", "plan"]
    assert T.type_hints("실패 결정 도구") == ["Tool", "Failure"]
    assert [T.exploration(q) for q in ("one two", "one two three", "a b c d e")] == [2.5, 1.0, 0.3]
    assert R.resolve_mode("correction") == ("auto", "correction") and R.resolve_mode("dmn") == ("dmn", "generic")


def test_vector_search_zero_rows_and_filters(spark):
    rows = [(1, "A", "p", [1.0, 0.0]), (2, "A", "q", [0.0, 0.0]), (3, "B", "p", [-1.0, 0.0]), (4, "B", "p", None)]
    df = spark.createDataFrame(rows, "id bigint, type string, project string, embedding array<float>")
    got = [(r["qid"], r["id"], r["distance"]) for r in search(df, [VectorQuery(0, [2.0, 0.0]), VectorQuery(1, [0.0, 0.0]),
           VectorQuery(2, [1.0, 0.0], type="B")], 2).orderBy("qid", "rank").collect()]
    assert got == [(0, 1, 0.0), (0, 2, 1.0), (2, 3, 2.0)]


@pytest.mark.parametrize("seed", range(6))
def test_diversity_limits_one_type(spark, seed):
    """Properties: as many rows as asked, no type over its share while others follow, the best of each type, in order."""
    rnd = random.Random(seed)
    rows = sorted(((i, rnd.choice("AAAAB" if seed % 2 else "AB"), round(rnd.random(), 6)) for i in range(15)), key=lambda r: -r[2])
    df = spark.createDataFrame([(0, i, t, s, n + 1, 5) for n, (i, t, s) in enumerate(rows)],
                               "qid bigint, id bigint, type string, score double, rank int, top_k int")
    got = [(r["id"], r["type"], r["score"]) for r in R.diversify(df).orderBy("rank").collect()]
    assert [s for *_, s in got] == sorted((s for *_, s in got), reverse=True)
    for kind in "AB":
        own = [r for r in rows if r[1] == kind]
        taken = [r for r in got if r[1] == kind]
        assert taken == own[:len(taken)]
    n_a, n_b = (sum(r[1] == kind for r in rows) for kind in "AB")
    assert len(got) == 5 if min(n_a, n_b) >= 2 else len(got) <= 5
    before = sum(r[1] == "A" for r in rows[:5])
    assert sum(r[1] == "A" for r in got) == min(max(before, 2), 3) if n_b >= 2 and n_a >= 2 else True


def test_diversity_without_later_rows(spark):
    df = spark.createDataFrame([(0, i, "A", 1.0 - i / 10, i + 1, 5) for i in range(5)], "qid bigint, id bigint, type string, score double, rank int, top_k int")
    assert [r["id"] for r in R.diversify(df).orderBy("rank").collect()] == list(range(5))


@pytest.mark.parametrize("by_type", [None, ["A", "B"]])
def test_neighbours_are_exact(spark, by_type, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(V, "BLOCK_ROWS", 20)
    x = rng.normal(size=(200, 6))
    x[50:120] = x[50] + 0.01 * rng.normal(size=(70, 6))
    x[7] = 0
    kinds = ["A" if i % 9 else "B" for i in range(200)]
    df = spark.createDataFrame([(i, kinds[i], "p", v.tolist()) for i, v in enumerate(x)], "id bigint, type string, project string, embedding array<double>")
    got = {(r["qid"], r["hint"], r["rank"]): (r["id"], r["distance"]) for r in V.neighbours(df, df, 4, by_type).collect()}
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    want = {}
    for q in range(200):
        for hint in (by_type or [""]) if norm[q] else []:
            d = np.round(1 - u @ u[q], 9)
            able = [i for i in range(200) if i != q and (not hint or kinds[i] == hint)]
            for rank, i in enumerate(sorted(able, key=lambda i: (d[i], i))[:4]):
                want[(q, hint, rank + 1)] = (i, d[i])
    assert got.keys() == want.keys()
    assert all(got[key][1] == pytest.approx(want[key][1], abs=2e-9) for key in want)
    assert sum(got[key][0] != want[key][0] for key in want) <= 0.02 * len(want)  # ties at the ninth digit


def test_neighbours_meet_in_bounded_groups(spark, monkeypatch):
    """No step holds more rows than a block, on either side, and equal rows leave no more than k hits each."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    x[100:400] = x[100]
    df = spark.createDataFrame([(i, "A", "p", v.tolist()) for i, v in enumerate(x)], "id bigint, type string, project string, embedding array<double>")
    matrix = V._matrix

    def watched(column):
        assert len(column) <= 80, "a group holds more than a block"
        return matrix(column)

    monkeypatch.setattr(V, "BLOCK_ROWS", 40)
    monkeypatch.setattr(V, "CELLS", 2)
    monkeypatch.setattr(V, "_matrix", watched)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {(r["qid"], r["rank"]): r["id"] for r in V.neighbours(df, df, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1800
    assert [got[(300, r)] for r in (1, 2, 3)] == [100, 101, 102] and [got[(100, r)] for r in (1, 2, 3)] == [101, 102, 103]


def test_saturation_boundary(spark):
    def run(projects):
        df = spark.createDataFrame([(0, p) for p in projects], "qid bigint, project string")
        return R.saturated(df).first()

    assert run("aaab")["saturated"] and run("aaab")["dominant"] == "a"
    assert not run("aabb")["saturated"] and not run("aa")["saturated"]


def test_intent_filter(spark):
    rows = [(1, "work_item", "user", "Decision"), (2, "", "pdr", "Narrative"), (3, "session_anchor", "user", "Narrative"), (4, "x", "user", "Tool")]
    df = spark.createDataFrame(rows, "id bigint, node_role string, source string, type string")
    ids = lambda i: [r["id"] for r in R.intent_filter(df, i).orderBy("id").collect()]
    assert ids("generic") == [4] and ids("recollection") == [2, 3, 4] and ids("troubleshooting") == [1, 3, 4] and ids("correction") == [1, 2, 3, 4]


def test_relation_inference(spark):
    rows = [("Signal", 1, "Pattern", 2, "a", "a", "realized_as"), ("Pattern", 2, "Signal", 1, "a", "a", "abstracted_from"),
            ("Tool", 1, "Goal", 1, "a", "b", "correlated_with"), ("Tool", 1, "Tool", 1, "a", "b", "mirrors"), ("Tool", 1, "Tool", 1, "a", "a", "supports"),
            ("Observation", 0, "Tool", 1, "a", "b", "generalizes_to"), ("Identity", 3, "Tool", 1, "", "", "expressed_as"),
            ("Tool", 1, "Goal", 1, "a", "a", "contains"), ("X", None, "Y", 1, "a", "b", "connects_with")]
    df = spark.createDataFrame(rows, "a string, al int, b string, bl int, ap string, bp string, want string")
    got = df.select(O.infer_relation(*[F.col(c) for c in ("a", "al", "b", "bl", "ap", "bp")]).alias("g"), "want").collect()
    assert [r["g"] for r in got] == [r["want"] for r in got]


def test_storage_relation_and_lenient_json(spark):
    df = spark.createDataFrame([("realizes", '["a"]'), ("nonsense", "{bad"), ("led_to", None)], "r string, j string")
    got = [(r[0], r[1]) for r in df.select(O.canonical_relation(F.col("r")), T.json_list(F.col("j"))).collect()]
    assert got == [("expressed_as", ["a"]), ("connects_with", []), ("led_to", [])]


def test_content_signature_keeps_empty_rows_apart(spark):
    df = spark.createDataFrame([(1, " x "), (2, "x"), (3, ""), (4, None)], "id bigint, c string")
    sig = [r[0] for r in df.select(T.content_signature(F.col("c"), F.col("id"))).collect()]
    assert sig[0] == sig[1] and len(set(sig)) == 3
