"""Kept tables: vector store versions, day partitions, percentiles by range counts."""

import random
import statistics

from loomgraph.operators.scale import weighted_percentiles
from loomgraph.operators.snapshots import read_days, write_days
from loomgraph.operators.vector_store import VectorStore


def content(store):
    return {r["id"]: list(r["embedding"]) for r in store.rows().collect()}


def test_vector_store_versions(spark):
    rows = lambda d: spark.createDataFrame(list(d.items()), "id bigint, embedding array<double>")
    first = VectorStore.create(rows({1: [1.0, 2.0], 2: [3.0, 4.0], 3: [5.0]}))
    second = first.put(rows({2: [0.5, 0.5], 9: [7.0]}))
    third = second.remove(spark.createDataFrame([(1,), (9,), (77,)], "id bigint"))
    fourth = third.put(rows({9: [8.0]}))
    want = {2: [0.5, 0.5], 3: [5.0], 9: [8.0]}
    assert content(fourth) == want and content(first) == {1: [1.0, 2.0], 2: [3.0, 4.0], 3: [5.0]}
    assert content(second) == {1: [1.0, 2.0], 2: [0.5, 0.5], 3: [5.0], 9: [7.0]}
    packed = fourth.compact()
    assert packed.log == [] and content(packed) == want and content(VectorStore.open(spark, packed.path)) == want
    assert tuple(packed.stats().first()) == (3, 1, 2, 16)
    assert content(packed.put(rows({2: [1.0]}).limit(0))) == want
    assert VectorStore.create(rows({1: [1.0]}).limit(0)).stats().first()["vectors"] == 0


def test_days_are_replaced_in_place(spark, tmp_path):
    path, schema = str(tmp_path / "days"), "id bigint, snapshot_date string"
    day = lambda ids, d: spark.createDataFrame([(i, d) for i in ids], schema)
    write_days(day([1, 2], "2024-01-01").union(day([3], "2024-01-02")), path)
    for _ in range(2):
        write_days(day([4, 5], "2024-01-02").union(day([6], "2024-01-03")), path)
    got = sorted(tuple(r) for r in read_days(spark, path, schema).collect())
    assert got == [(1, "2024-01-01"), (2, "2024-01-01"), (4, "2024-01-02"), (5, "2024-01-02"), (6, "2024-01-03")]
    late = read_days(spark, path, schema, "2024-01-02")
    assert {r[0] for r in late.collect()} == {4, 5, 6} and "PartitionFilters: [isnotnull(snapshot_date" in late._jdf.queryExecution().executedPlan().toString()


def test_percentiles_by_range_counts(spark):
    rnd = random.Random(3)
    rows = [("many", rnd.random(), rnd.randrange(1, 4)) for _ in range(2000)] + [("hot", 1.5, 1000), ("hot", 2.5, 1000), ("one", 7.0, 1), ("two", 1.0, 1), ("two", 2.0, 1)]
    got = {(r["k"], r["p"]): r["at"] for r in weighted_percentiles(spark.createDataFrame(rows, "k string, v double, w bigint"), "k", "v", "w", [0.0, 0.5, 0.9, 1.0]).collect()}
    for key in ("many", "hot", "one", "two"):
        flat = sorted(v for k, v, w in rows if k == key for _ in range(w))
        for p in (0.0, 0.5, 0.9, 1.0):
            at = p * (len(flat) - 1)
            lo, hi = int(at), min(int(at) + 1, len(flat) - 1)
            assert abs(got[(key, p)] - (flat[lo] + (at - int(at)) * (flat[hi] - flat[lo]))) < 1e-9
        assert abs(got[(key, 0.5)] - statistics.median(flat)) < 1e-9
