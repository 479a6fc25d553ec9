"""Graph and mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.functions.vector import neighbours
from loomgraph.operators import graph as G
from loomgraph.operators import mining as M
from loomgraph.plans.registry import query
from loomgraph.plans.sqlparts import BACK, CANON, LIVE, RULES, ends, infer, quoted

ENDPTS = "SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges"


@query("gr05_strong_edge_exploration", "GR5", "nodes edges", f"""WITH RECURSIVE act AS (SELECT * FROM edges WHERE status = 'active' AND strength >= 0.3
 AND coalesce(generation_method, '') NOT IN ({quoted(O.GRAPH_EXCLUDED_METHODS)})), {ends('act')},
walk(id, hop) AS (SELECT 0, 0 UNION SELECT e.nbr, w.hop + 1 FROM walk w JOIN ends e ON e.nid = w.id WHERE w.hop < 2)
SELECT DISTINCT CAST(id AS BIGINT) AS id FROM walk WHERE id <> 0""")
def gr05(t):
    seeds = t.spark.createDataFrame([(0, 0)], "qid bigint, id bigint")
    return G.explore(t.edges, seeds).select("id")


@query("gr06_shortest_paths", "GR6", "nodes edges", f"""WITH RECURSIVE act AS (SELECT * FROM edges WHERE status = 'active'), {ends('act')},
walk(id, hop) USING KEY (id) AS (SELECT CAST(20 AS BIGINT), 0 UNION SELECT e.nbr, min(w.hop) + 1 FROM walk w JOIN ends e ON e.nid = w.id
 WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.id = e.nbr) GROUP BY e.nbr),
dist AS (SELECT id, hop FROM walk),
tree AS (SELECT d.id, d.hop, min(p.id) AS parent FROM dist d JOIN ends e ON e.nbr = d.id JOIN dist p ON p.id = e.nid AND p.hop = d.hop - 1 GROUP BY d.id, d.hop)
SELECT t.id, t.hop, t.parent, arg_min(CASE WHEN e.outw THEN e.relation ELSE '<-' || e.relation END, (NOT e.outw, e.edge_id)) AS label
FROM tree t JOIN ends e ON e.nid = t.parent AND e.nbr = t.id GROUP BY 1, 2, 3""")
def gr06(t):
    tree = G.shortest_paths(t.edges, 20)
    return G.path_labels(t.edges, tree)


@query("gr07_degree", "GR7 JN8 SO1", "edges", f"SELECT id, count(*) AS degree FROM ({ENDPTS}) GROUP BY id")
def gr07(t):
    return G.degree(t.edges)


@query("gr08_hub_percentile", "GR8", "edges", """WITH d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges WHERE status = 'active'
 UNION ALL SELECT target_id FROM edges WHERE status = 'active') GROUP BY id), r AS (SELECT *, row_number() OVER (ORDER BY degree DESC) - 1 AS pos, count(*) OVER () AS n FROM d)
SELECT id, degree FROM d WHERE degree >= (SELECT degree FROM r WHERE pos = floor(n * (1 - CAST(95 AS DOUBLE) / 100)))""")
def gr08(t):
    return G.hubs(t.edges, 95)


@query("gr09_hub_scores", "GR9 GR10 MX8", "nodes edges", """SELECT n.id, n.type, n.layer, count(e.id) AS ihs_score,
 CASE WHEN count(e.id) > 50 THEN 'HIGH' WHEN count(e.id) > 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM nodes n LEFT JOIN edges e ON e.target_id = n.id WHERE n.status = 'active' GROUP BY ALL ORDER BY ihs_score DESC, n.id LIMIT 20""")
def gr09(t):
    return G.in_degree(t.nodes, t.edges, 20).withColumn("risk", G.hub_risk(F.col("ihs_score"))).select(
        "id", "type", "layer", "ihs_score", "risk")


@query("gr11_orphans", "GR11 JN5 JN6 JN7 JN17", "nodes edges", f"""WITH {LIVE}
SELECT 'any' AS rule, id FROM nodes WHERE status = 'active' AND id NOT IN ({ENDPTS})
UNION ALL SELECT 'active', n.id FROM nodes n WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.status = 'active' AND e.source_id = n.id)
 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.status = 'active' AND e.target_id = n.id)
UNION ALL SELECT 'active_both', id FROM nodes WHERE status = 'active' AND id NOT IN (SELECT source_id FROM live UNION SELECT target_id FROM live)""")
def gr11(t):
    parts = [G.orphans(t.nodes, t.edges, r).select(F.lit(r).alias("rule"), "id") for r in ("any", "active", "active_both")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("gr12_single_edge_nodes", "GR12 JN8 AG4", "nodes edges", f"""WITH act AS (SELECT * FROM edges WHERE status = 'active'), {ends('act')}
SELECT n.id FROM nodes n JOIN ends e ON e.nid = n.id WHERE n.status = 'active' GROUP BY n.id HAVING count(*) = 1""")
def gr12(t):
    return G.single_edge_nodes(t.nodes, t.edges).select("id")


@query("gr13_dense_clusters", "GR13 LT9", "nodes edges", f"""WITH RECURSIVE deg AS (SELECT id, count(*) AS degree FROM ({ENDPTS}) GROUP BY id),
seeds AS (SELECT *, row_number() OVER (ORDER BY degree DESC, id) AS pos FROM deg ORDER BY degree DESC, id LIMIT 50), {ends('edges')},
near AS (SELECT nid, nbr, row_number() OVER (PARTITION BY nid ORDER BY nbr) AS k FROM (SELECT DISTINCT nid, nbr FROM ends JOIN seeds ON seeds.id = nid)),
cand AS (SELECT s.pos, s.id AS seed, s.degree, list(n.nbr ORDER BY n.nbr) AS members, count(a.id) + (SELECT count(*) FROM nodes x WHERE x.id = s.id AND x.status = 'active') AS alive
 FROM seeds s JOIN near n ON n.nid = s.id AND n.k <= 14 LEFT JOIN nodes a ON a.id = n.nbr AND a.status = 'active' GROUP BY s.pos, s.id, s.degree),
walk AS (SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS taken, false AS ok UNION ALL
 SELECT pos, CASE WHEN good THEN list_concat(taken, list_append(members, seed)) ELSE taken END, good FROM (
  SELECT c.pos, c.members, c.seed, w.taken, NOT list_contains(w.taken, c.seed) AND len(c.members) >= 9 AND c.alive >= 10 AS good FROM walk w JOIN cand c ON c.pos = w.pos + 1))
SELECT c.seed, c.degree, len(c.members) AS neighbours, array_to_string(c.members, ',') AS members FROM walk w JOIN cand c ON c.pos = w.pos WHERE w.ok""")
def gr13(t):
    return G.dense_clusters(t.nodes, t.edges).select("seed", "degree", F.size("members").alias("neighbours"),
                                                     F.array_join("members", ",").alias("members"))


@query("gr14_temporal_sequences", "GR14 WN2 AG18 LT11", "nodes", """SELECT project, id, pos FROM (SELECT *, count(*) OVER (PARTITION BY project) AS len FROM (
 SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY created_at, id) AS pos FROM nodes WHERE status = 'active' AND project <> '') WHERE pos <= 20) WHERE len >= 3""")
def gr14(t):
    return G.temporal_sequences(t.nodes).select("project", "id", "pos")


def _components_sql(where: str) -> str:
    return f"""WITH RECURSIVE {LIVE}, sp AS (SELECT * FROM live WHERE {where}), {ends('sp')},
walk AS (SELECT DISTINCT nid AS id, nid AS root FROM ends UNION SELECT e.nbr, w.root FROM walk w JOIN (SELECT DISTINCT nid, nbr FROM ends) e ON e.nid = w.id)
SELECT id, min(root) AS component FROM walk GROUP BY id"""


@query("gr15_connected_components", "GR15", "nodes edges", _components_sql("TRUE"))
def gr15(t):
    pairs = G.live_edges(t.nodes, t.edges)
    return G.components(pairs.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@query("gr15_contradiction_components", "GR15", "nodes edges", _components_sql("relation = 'contradicts'"))
def gr15_contradictions(t):
    pairs = G.live_edges(t.nodes, t.edges.where("relation = 'contradicts'"))
    return G.components(pairs.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@query("gr19_signal_clusters", "GR16 GR17 GR18 GR19 JN14 FLT6", "nodes recall_log", """WITH RECURSIVE sig AS (SELECT * FROM nodes WHERE type = 'Signal' AND status = 'active'),
f AS (SELECT id, unnest(list_concat(list_concat(list_transform(list_filter(list_transform(string_split(tags, ','), lambda x: lower(trim(x))), lambda x: x <> ''), lambda x: 'tag:' || x),
  list_transform(key_concepts, lambda x: 'concept:' || x)), list_transform(domains, lambda x: 'domain:' || x))) AS feature FROM sig),
adj AS (SELECT DISTINCT a.id AS x, b.id AS y FROM f a JOIN f b ON a.feature = b.feature),
walk AS (SELECT id, id AS root FROM sig UNION SELECT a.y, w.root FROM walk w JOIN adj a ON a.x = w.id),
comp AS (SELECT id, min(root) AS component FROM walk GROUP BY id),
m AS (SELECT s.*, c.component FROM sig s JOIN comp c ON c.id = s.id),
tot AS (SELECT count(DISTINCT recall_id) AS n FROM recall_log),
d AS (SELECT component, count(*) AS nd, string_agg(d, ',' ORDER BY d) AS domains FROM (SELECT DISTINCT component, unnest(domains) AS d FROM m) GROUP BY component),
th AS (SELECT component, string_agg(theme, '|' ORDER BY k) AS themes FROM (SELECT component, coalesce(nullif(summary, ''), substr(content, 1, 80)) AS theme, row_number() OVER (PARTITION BY component ORDER BY id) AS k FROM m) WHERE k <= 3 GROUP BY component),
g AS (SELECT component, count(*) AS size, avg(coalesce(nullif(quality_score, 0), 0.5)) AS q, CAST(sum(promotion_candidate) AS BIGINT) AS fl FROM m GROUP BY component HAVING count(*) >= 2),
z AS (SELECT g.*, d.domains, th.themes, least(1.0, CAST(size AS DOUBLE) / 10) * 0.5 + q * 0.3 + least(1.0, CAST(nd AS DOUBLE) / 3) * 0.2 AS ready, CAST(1 AS DOUBLE) / (11 + tot.n) AS bp
 FROM g JOIN d ON d.component = g.component JOIN th ON th.component = g.component, tot)
SELECT component, size, round(ready, 6) AS cluster_readiness, round(bp, 9) AS bayesian_p, fl AS sprt_flagged,
 CASE WHEN ready > 0.9 AND bp > 0.6 THEN 'auto_promote' WHEN bp > 0.5 OR fl >= 2 OR ready > 0.6 THEN 'user_review' ELSE 'not_ready' END AS recommendation, themes, domains FROM z""")
def gr19(t):
    total = t.recall_log.select(F.count_distinct("recall_id")).first()[0]
    return M.signal_clusters(t.nodes, total, top_k=None)


CO = """pairs AS (SELECT a, b, sum(c) AS co_count FROM (
 SELECT x.node_id AS a, y.node_id AS b, count(*) AS c FROM (SELECT DISTINCT recall_id, node_id FROM recall_log WHERE recall_id IS NOT NULL) x
  JOIN (SELECT DISTINCT recall_id, node_id FROM recall_log WHERE recall_id IS NOT NULL) y ON y.recall_id = x.recall_id AND x.node_id < y.node_id GROUP BY 1, 2 HAVING count(*) >= {m}
 UNION ALL SELECT x.node_id, y.node_id, count(*) FROM (SELECT DISTINCT query, day, node_id FROM recall_log WHERE recall_id IS NULL) x
  JOIN (SELECT DISTINCT query, day, node_id FROM recall_log WHERE recall_id IS NULL) y ON y.query = x.query AND y.day = x.day AND x.node_id < y.node_id GROUP BY 1, 2 HAVING count(*) >= {m}) GROUP BY a, b)"""


@query("gr20_co_retrieval", "GR20 JN13 AG7 SNK3", "edges recall_log", f"""WITH {CO.format(m=3)}, d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges WHERE status = 'active'
 UNION ALL SELECT target_id FROM edges WHERE status = 'active') GROUP BY id), r AS (SELECT *, row_number() OVER (ORDER BY degree DESC) - 1 AS pos, count(*) OVER () AS n FROM d),
hub AS (SELECT id FROM d WHERE degree >= (SELECT degree FROM r WHERE pos = floor(n * (1 - CAST(95 AS DOUBLE) / 100)))),
old AS (SELECT source_id, target_id, min(id) AS edge_id FROM edges WHERE relation = 'co_retrieved' AND status = 'active' GROUP BY ALL)
SELECT p.a AS source_id, p.b AS target_id, CAST(p.co_count AS BIGINT) AS co_count, round(least(CAST(0.1 AS DOUBLE) * (p.co_count - 3 + 1), 0.5), 6) AS boost, o.edge_id,
 CASE WHEN o.edge_id IS NULL THEN 'insert' ELSE 'update' END AS action
FROM pairs p LEFT JOIN old o ON o.source_id = p.a AND o.target_id = p.b WHERE NOT (p.a IN (FROM hub) AND p.b IN (FROM hub))""")
def gr20(t):
    return M.co_retrieval(t.recall_log, t.edges, min_count=3, legacy_stamp="day")


def _cross_sql(f):
    return f"""SELECT '{f}' AS shared_field, v.value, d.n_domains, count(*) AS n_nodes, array_to_string((list(CAST(v.id AS VARCHAR) ORDER BY v.id))[1:8], ',') AS members
FROM (SELECT DISTINCT id, unnest({f}[1:3]) AS value FROM nodes WHERE status = 'active') v
JOIN (SELECT value, count(DISTINCT d) AS n_domains FROM (SELECT unnest({f}[1:3]) AS value, domains FROM nodes WHERE status = 'active'), unnest(domains) x(d) GROUP BY value) d ON d.value = v.value
WHERE length(v.value) >= 2 AND d.n_domains >= 2 GROUP BY v.value, d.n_domains HAVING count(*) >= 2"""


@query("gr21_cross_domain_clusters", "GR21 LT4", "nodes", f"{_cross_sql('key_concepts')} UNION ALL {_cross_sql('facets')}")
def gr21(t):
    return M.cross_domain_clusters(t.nodes, "key_concepts").unionAll(M.cross_domain_clusters(t.nodes, "facets"))


@query("gr22_random_cross_domain", "GR22 TK6", "nodes")
def gr22(t):
    return M.random_cross_domain(t.nodes)


@query("jn15_similar_pairs", "JN15 LT12 LT15", "nodes", """WITH c AS (SELECT id, type, project, list_sort(list_distinct(list_transform(key_concepts, lambda x: lower(trim(x))))) AS cs FROM nodes WHERE status = 'active' AND len(key_concepts) > 0),
f AS (SELECT *, min(id) OVER (PARTITION BY cs, type, project) AS fid FROM c)
SELECT least(a.fid, b.fid) AS a, greatest(a.fid, b.fid) AS b, count(*) AS pairs FROM f a JOIN f b ON a.id < b.id AND (a.type = b.type OR a.project = b.project)
WHERE CAST(len(list_intersect(a.cs, b.cs)) AS DOUBLE) / len(list_distinct(list_concat(a.cs, b.cs))) >= 0.85 GROUP BY 1, 2""")
def jn15(t):
    return M.similar_pairs(t.nodes)


@query("gr23_domain_type_counts", "GR23 LT16", "nodes", """SELECT domain, type, count(*) AS n FROM (SELECT unnest(CASE WHEN len(domains) > 0 THEN domains ELSE [project] END) AS domain, type FROM nodes WHERE status = 'active') GROUP BY ALL""")
def gr23(t):
    return M.domain_type_counts(t.nodes)


@query("gr24_connected_and_similar", "GR24 LT13 LT14", "nodes edges", f"""WITH {ends('edges')}, piv AS (SELECT * FROM nodes WHERE status = 'active' AND type = 'Decision'),
con AS (SELECT nid, nbr, row_number() OVER (PARTITION BY nid ORDER BY nbr) AS pos FROM (SELECT DISTINCT nid, nbr FROM ends WHERE nid IN (SELECT id FROM piv) AND nbr IN (SELECT id FROM nodes WHERE status = 'active'))),
cand AS (SELECT p.id, n.id AS nid, row_number() OVER (PARTITION BY p.id ORDER BY n.created_at DESC, n.id) AS age, len(list_intersect(list_transform(p.key_concepts, lambda x: lower(trim(x))), list_transform(n.key_concepts, lambda x: lower(trim(x))))) AS overlap
 FROM piv p JOIN nodes n ON n.status = 'active' AND n.id <> p.id AND (n.type = p.type OR n.project = p.project)),
sim AS (SELECT id, nid, overlap, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, age) AS pos FROM cand WHERE age <= 15)
SELECT 'connected' AS kind, nid AS pivot, nbr AS node_id, CAST(NULL AS INTEGER) AS overlap, pos FROM con WHERE pos <= 20
UNION ALL SELECT 'similar', id, nid, CAST(overlap AS INTEGER), pos FROM sim WHERE pos <= 5""")
def gr24(t):
    piv = G.active(t.nodes).where("type = 'Decision'")
    con = M.connected_nodes(piv, t.nodes, t.edges).select(F.lit("connected").alias("kind"), "pivot", F.col("nbr").alias("node_id"),
                                                         F.lit(None).cast("int").alias("overlap"), "pos")
    sim = M.similar_nodes(piv, t.nodes).select(F.lit("similar").alias("kind"), "pivot", F.col("nid").alias("node_id"), "overlap", "pos")
    return con.unionAll(sim)


@query("gr25_diverse_neighbours", "GR25 LT10", "nodes edges", f"""WITH act AS (SELECT id, type, project, layer, created_at, coalesce(visit_count, -1) AS v FROM nodes WHERE status = 'active'),
tg AS (SELECT * FROM act WHERE project <> '' AND id NOT IN ({ENDPTS})),
s AS (SELECT t.id, n.id AS nid, 1 AS slot, row_number() OVER (PARTITION BY t.id ORDER BY n.created_at DESC, n.id) AS p FROM tg t JOIN act n ON n.project = t.project AND n.type = t.type AND n.id <> t.id
 UNION ALL SELECT t.id, n.id, 2, row_number() OVER (PARTITION BY t.id ORDER BY n.v DESC, n.id) FROM tg t JOIN act n ON n.project = t.project AND n.layer <> t.layer AND n.id <> t.id
 UNION ALL SELECT t.id, n.id, 3, row_number() OVER (PARTITION BY t.id ORDER BY n.v DESC, n.id) FROM tg t JOIN act n ON n.type = t.type AND n.project <> t.project AND n.project <> '' AND n.id <> t.id
 UNION ALL SELECT t.id, n.id, 4, row_number() OVER (PARTITION BY t.id ORDER BY n.v DESC, n.id) FROM tg t JOIN act n ON n.project = t.project AND n.id <> t.id),
o AS (SELECT id, nid, min(slot) AS slot, arg_min(p, slot) AS p FROM s WHERE p <= 3 GROUP BY id, nid)
SELECT id, nid, slot, pos FROM (SELECT id, nid, slot, row_number() OVER (PARTITION BY id ORDER BY slot, p) AS pos FROM o) WHERE pos <= 12""")
def gr25(t):
    return M.diverse_neighbours(G.orphans(t.nodes, t.edges, "any"), t.nodes)


@query("gr26_duplicate_edges", "GR26 LT8", "edges", """SELECT source_id, target_id, count(*) AS edge_count,
 CASE WHEN count(DISTINCT relation) > 1 THEN 'different_relations' WHEN bool_or(trim(coalesce(description, '')) NOT IN ('', '[]')) THEN 'same_relation_described' ELSE 'auto_merge' END AS kind,
 (list(id ORDER BY coalesce(strength, 0) DESC, id))[1] AS keep_id FROM edges WHERE status = 'active' GROUP BY source_id, target_id HAVING count(*) > 1""")
def gr26(t):
    return M.duplicate_edges(t.edges)


KB = ["Decision", "Failure", "Pattern", "Insight", "Principle", "Framework", "Signal"]


TOPICS = "(SELECT id AS vec_id, embedding FROM topic_vectors)"


def island_sql(vectors: str, least: float) -> str:
    return f"""WITH {RULES}, {BACK}, {CANON}, sem AS (SELECT * FROM edges WHERE status = 'active' AND generation_method IN ('rule', 'semantic_auto', 'enrichment', 'manual')), {ends('sem')},
isl AS (SELECT n.* FROM nodes n LEFT JOIN (SELECT nid, count(*) AS d FROM ends GROUP BY nid) g ON g.nid = n.id WHERE n.status = 'active' AND n.type IN ({quoted(KB)}) AND coalesce(d, 0) <= 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY distance, tid) AS rank FROM (SELECT a.vec_id AS sid, b.vec_id AS tid,
 round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance FROM {vectors} a, {vectors} b JOIN nodes n ON n.id = b.vec_id
 WHERE n.status = 'active' AND a.vec_id <> b.vec_id AND a.vec_id IN (SELECT id FROM isl))) WHERE rank <= 5)
SELECT s.id AS source_id, t.id AS target_id, coalesce((SELECT stored FROM canon WHERE rel = {infer('s', 't')}), {infer('s', 't')}) AS relation, round(1 - k.distance, 9) AS cosine
FROM k JOIN nodes s ON s.id = k.sid JOIN nodes t ON t.id = k.tid WHERE round(1 - k.distance, 9) >= {least}
 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.status = 'active' AND ((e.source_id = k.sid AND e.target_id = k.tid) OR (e.source_id = k.tid AND e.target_id = k.sid)))"""


def _island_links(t, vectors, **kw):
    lonely = M.islands(t.nodes, t.edges, KB)
    corpus = vectors.join(G.active(t.nodes).select("id", "type", "project"), "id")
    return M.island_links(lonely, t.nodes, t.edges, neighbours(vectors.join(lonely.select("id"), "id", "left_semi"), corpus, 5), **kw)


@query("gr29_island_links", "GR29", "nodes edges", island_sql("embeddings", 0.3))
def gr29(t):
    """The raw vectors have no structure: a weaker bound."""
    return _island_links(t, t.embeddings, min_cosine=0.3)


@query("gr29_island_links_defined", "GR29", "nodes edges topic_vectors", island_sql(TOPICS, 0.55))
def gr29_defined(t):
    return _island_links(t, t.topic_vectors)


def causal_sql(vectors: str, slack: float) -> str:
    return f"""WITH rules(st, relation, hint, ord, m) AS (VALUES {', '.join(f"('{s}', '{r}', '{x}', {i}, {round(m - slack, 2)})" for s, r, xs, m in M.CAUSAL_RULES for i, x in enumerate(xs))}),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, hint ORDER BY distance, id) AS rank FROM (
 SELECT a.vec_id AS qid, b.vec_id AS id, n.type AS hint, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance
 FROM {vectors} a, {vectors} b JOIN nodes n ON n.id = b.vec_id WHERE n.status = 'active' AND a.vec_id <> b.vec_id)) WHERE rank <= 5),
g AS (SELECT s.id AS source_id, t.id AS target_id, r.relation, round(1 - k.distance, 9) AS cosine, row_number() OVER (PARTITION BY s.id, r.relation ORDER BY r.ord, k.rank) AS first
 FROM nodes s JOIN rules r ON r.st = s.type JOIN near k ON k.qid = s.id AND k.hint = r.hint JOIN nodes t ON t.id = k.id
 WHERE s.status = 'active' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.status = 'active' AND e.source_id = s.id AND e.relation = r.relation)
  AND round(1 - k.distance, 9) >= r.m AND (s.project = t.project OR round(1 - k.distance, 9) >= r.m + 0.10))
SELECT source_id, target_id, relation, cosine FROM g WHERE first = 1"""


def _causal_links(t, vectors, **kw):
    corpus = vectors.join(G.active(t.nodes).select("id", "type", "project"), "id")
    hints = sorted({x for _, _, xs, _ in M.CAUSAL_RULES for x in xs})
    return M.causal_links(t.nodes, t.edges, neighbours(vectors, corpus, 5, hints), **kw)


@query("gr30_causal_links", "GR30", "nodes edges", causal_sql("embeddings", 0.2))
def gr30(t):
    return _causal_links(t, t.embeddings, slack=0.2)


@query("gr30_causal_links_defined", "GR30", "nodes edges topic_vectors", causal_sql(TOPICS, 0.0))
def gr30_defined(t):
    return _causal_links(t, t.topic_vectors)


@query("gr31_induced_subgraph", "GR31 SNK9", "nodes edges", f"""WITH {LIVE}, r AS (SELECT id FROM nodes WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 100)
SELECT id, source_id, target_id, relation FROM live WHERE source_id IN (FROM r) AND target_id IN (FROM r)""")
def gr31(t):
    from loomgraph.operators.tables import recent_nodes
    return G.induced(t.nodes, t.edges, recent_nodes(t.nodes, limit=100)).select("id", "source_id", "target_id", "relation")


@query("gr32_inspect_node", "GR32 JN2 SRC2", "nodes edges", f"""WITH {LIVE}, {ends('live')}
SELECT CASE WHEN outw THEN 'outgoing' ELSE 'incoming' END AS direction, e.edge_id, e.relation, e.strength, e.nbr AS neighbour_id, n.type, substr(coalesce(n.summary, n.content), 1, 100) AS preview
FROM ends e JOIN nodes n ON n.id = e.nbr WHERE e.nid = 20""")
def gr32(t):
    return G.inspect(t.nodes, t.edges, 20)


@query("jn01_live_edges", "JN1 JN4", "nodes edges", f"WITH {LIVE} SELECT id, source_id, target_id, relation, strength FROM live")
def jn01(t):
    return G.live_edges(t.nodes, t.edges).select("id", "source_id", "target_id", "relation", "strength")


@query("ret13_contradicted_nodes", "RET13 SO2", "nodes edges", f"""WITH {LIVE} SELECT source_id AS id FROM live WHERE relation = 'contradicts' UNION SELECT target_id FROM live WHERE relation = 'contradicts'""")
def ret13(t):
    from loomgraph.operators.retrieval import contradicted
    return contradicted(t.nodes, t.edges)


@query("gr27_edge_selections", "GR27 LT5 LT6 LT7 LT17", "edges", """SELECT 'generic' AS kind, id FROM edges WHERE status = 'active' AND relation IN ('connects_with', 'supports')
UNION ALL SELECT 'undirected', id FROM edges WHERE status = 'active' AND coalesce(direction, '') = ''
UNION ALL SELECT 'undescribed', id FROM edges WHERE status = 'active' AND trim(coalesce(description, '')) IN ('', '[]')""")
def gr27(t):
    e = G.active(t.edges)
    kinds = {"generic": F.col("relation").isin("connects_with", "supports"), "undirected": F.coalesce("direction", F.lit("")) == "",
             "undescribed": F.trim(F.coalesce("description", F.lit(""))).isin("", "[]")}
    marks = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    return e.select(F.explode(marks).alias("kind"), "id")
