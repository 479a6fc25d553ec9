import itertools
import random

from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import mining as M
from loomgraph.operators import scale
from loomgraph.operators.scale import carry_previous, numbered, shared_item_candidates, shared_item_counts


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_endpoints_count_a_self_loop_once_and_degree_twice(graph):
    _, edges = graph
    assert G.endpoints(edges).where("nid = 5").count() == 1
    assert {r["id"]: r["degree"] for r in G.degree(edges).collect()}[5] == 2


def test_three_orphan_rules_differ(graph):
    nodes, edges = graph
    assert ids(G.orphans(nodes, edges, "any")) == []
    assert ids(G.orphans(nodes, edges.where("id <> 18"), "active")) == [7]
    cut = edges.where("id not in (10, 12, 16, 18)")
    assert ids(G.orphans(nodes, cut, "active")) == [7]
    assert ids(G.orphans(nodes, cut, "active_both")) == [1, 7]


def test_reachability_skips_excluded_methods_and_seeds(spark, graph):
    _, edges = graph
    seeds = spark.createDataFrame([(0, 4)], "qid bigint, id bigint")
    assert ids(G.reachable(edges, seeds, 1)) == [3]
    assert ids(G.reachable(edges, seeds, 2)) == [1, 2, 3]
    found = G.best_edge_class(edges, seeds, G.reachable(edges, seeds, 2))
    assert {r["id"]: r["edge_class"] for r in found.collect()} == {3: "structural", 1: "", 2: ""}


def test_ucb_prefers_the_unvisited_and_uses_the_latest_parallel_edge(spark, graph):
    nodes, edges = graph
    seeds = spark.createDataFrame([(0, 1, 2.5)], "qid bigint, id bigint, c double")
    rows = G.ucb_traverse(nodes, edges, seeds, depth=1, width=1).collect()
    # node 2 has no visits; its latest edge from 1 is connects_with, an operational one
    assert [(r["id"], r["edge_class"]) for r in rows] == [(2, "operational")]


def test_shortest_paths_and_labels(graph):
    nodes, edges = graph
    tree = {r["id"]: (r["hop"], r["parent"]) for r in G.shortest_paths(edges, 4).collect()}
    assert tree[4] == (0, None) and tree[3] == (1, 4) and tree[1] == (2, 3) and tree[6] == (3, 1)
    labels = {r["id"]: r["label"] for r in G.path_labels(edges, G.shortest_paths(edges, 4)).collect()}
    assert labels[3] == "<-contains" and labels[1] == "contradicts"


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_on_chain_star_and_random(spark):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1001, 1060)]
    rest = [(rnd.randrange(2000, 2200), rnd.randrange(2000, 2200)) for _ in range(90)]
    pairs = chain + star + rest
    got = {r["id"]: r["component"] for r in G.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == brute_components(pairs)


def test_large_groups_propose_few_pairs(spark):
    """Thirty sessions of some 500 nodes, each node in three of them: pairs within sessions are millions, those that can share three are few."""
    rnd = random.Random(9)
    rows = [(n, g) for n in range(5000) for g in rnd.sample(range(30), 3)]
    live = spark.createDataFrame(rows, "n bigint, g bigint").withColumn("size", F.lit(500))
    got = {(r["a"], r["b"]) for r in shared_item_candidates(live, live, 3).collect()}
    own = {}
    for n, g in rows:
        own.setdefault(n, set()).add(g)
    by = {}
    for n, gs in own.items():
        by.setdefault(frozenset(gs), []).append(n)
    want = {p for ns in by.values() for p in itertools.combinations(ns, 2)}
    assert want <= got and len(got) < 3 * len(rows)


def test_shared_item_counts_equals_all_pairs_even_with_a_giant_group(spark):
    rnd = random.Random(9)
    rows = [(n, "giant") for n in range(60)] + [(rnd.randrange(60), f"g{rnd.randrange(40)}") for _ in range(500)]
    log = spark.createDataFrame(rows, "n bigint, g string")
    groups = {}
    for n, g in set(rows):
        groups.setdefault(g, set()).add(n)
    want = {}
    for members in groups.values():
        for p in itertools.combinations(sorted(members), 2):
            want[p] = want.get(p, 0) + 1
    for least in (1, 2, 4):
        got = {(r["a"], r["b"]): r["shared"] for r in shared_item_counts(log, "n", "g", least).collect()}
        assert got == {p: c for p, c in want.items() if c >= least}


def test_carry_previous_equals_lag(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), rnd.randrange(30)) for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, k string, t int")
    got = {r["id"]: r["prev"] for r in carry_previous(df, "k", (df["t"] / 7).cast("int"), ["t", "id"], "id", "prev").collect()}
    want = {}
    for key in "ab":
        seq = [i for i, _, _ in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))]
        want.update(dict(zip(seq, [None, *seq])))
    assert got == want


def test_numbered_is_a_global_rank(spark):
    keys = random.Random(1).sample(range(10000), 300)
    got = {r["id"]: r["pos"] for r in numbered(spark.createDataFrame([(k,) for k in keys], "id bigint"), "id", "pos").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_similar_pairs_counts_all_pairs_of_larger_sets(spark):
    rnd = random.Random(5)
    base = [list("abcdefg"), list("abcdefgh"), list("mnopqrst"), list("mnopqrs"), ["x"], ["x", "y"]]
    rows = [(i, rnd.choice("TU"), rnd.choice("PQ"), "active", rnd.choice(base)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, type string, project string, status string, key_concepts array<string>")
    got = sum(r["pairs"] for r in M.similar_pairs(df).collect())
    want = sum(1 for a, b in itertools.combinations(rows, 2)
               if (a[1] == b[1] or a[2] == b[2]) and len(set(a[4]) & set(b[4])) / len(set(a[4]) | set(b[4])) >= 0.85)
    assert got == want


def test_dense_clusters_equal_the_greedy_walk(spark):
    rnd = random.Random(6)
    edges = [(i, rnd.randrange(40), rnd.randrange(40)) for i in range(160)]
    status = {i: "archived" if i % 9 == 0 else "active" for i in range(40)}
    nf = spark.createDataFrame(list(status.items()), "id bigint, status string")
    ef = spark.createDataFrame(edges, "id bigint, source_id bigint, target_id bigint")
    deg, near = {}, {}
    for _, s, t in edges:
        for a, b in ((s, t), (t, s)):
            deg[a] = deg.get(a, 0) + 1
            near.setdefault(a, set()).add(b)
    want, taken = [], set()
    for seed in sorted(deg, key=lambda n: (-deg[n], n))[:50]:
        members = sorted(near[seed])[:7]
        if seed in taken or len(members) + 1 < 5:
            continue
        if sum(status[m] == "active" for m in members) + (status[seed] == "active") < 5:
            continue
        want.append((seed, members))
        taken |= {seed, *members}
    got = [(r["seed"], r["members"]) for r in G.dense_clusters(nf, ef, min_size=5, max_size=8).collect()]
    assert sorted(got) == sorted(want)


def test_nodes_of_the_same_groups_are_counted_once(spark, monkeypatch):
    """Three sessions of 400 nodes: the pairs are the answer, but only one node of a kind is compared."""
    asked = []
    plain = scale.shared_item_candidates
    monkeypatch.setattr(scale, "CHUNK", 50)
    monkeypatch.setattr(scale, "shared_item_candidates", lambda prefix, live, least: asked.append(live.select("n").distinct().count()) or plain(prefix, live, least))
    rows = [(n, g) for n in range(400) for g in (["a", "b", "c"] if n % 2 else ["b", "c", "d"])] + [(n, "e") for n in range(0, 400, 50)]
    got = {(r["a"], r["b"]): r["shared"] for r in scale.shared_item_counts(spark.createDataFrame(rows, "n bigint, g string"), "n", "g", 3, spark.createDataFrame([(1,), (2,), (3,)], "id bigint")).collect()}
    own = {}
    for n, g in rows:
        own.setdefault(n, set()).add(g)
    want = {p: len(own[p[0]] & own[p[1]]) for p in itertools.combinations(range(400), 2) if len(own[p[0]] & own[p[1]]) >= 3 and not set(p) <= {1, 2, 3}}
    assert got == want and asked == [2]
