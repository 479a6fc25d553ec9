"""Quality checks, reports and ranking evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.fixtures import AS_OF
from loomgraph.functions.vector import cosine
from loomgraph.operators import evaluation as E
from loomgraph.operators import graph as G
from loomgraph.operators import quality as Q
from loomgraph.plans.registry import query
from loomgraph.plans.sqlparts import LIVE, NOW, quoted

ORPH = "SELECT count(*) FROM nodes n WHERE status = 'active' AND id NOT IN (SELECT source_id FROM edges WHERE status = 'active' UNION SELECT target_id FROM edges WHERE status = 'active')"
TOTAL = "(SELECT count(*) FROM nodes WHERE status = 'active')"


def _check(name, cat, score, thr, higher=True):
    bad, worse = ("<", "0.8") if higher else (">", "1.2")
    return f"""SELECT '{name}' AS name, '{cat}' AS category, round(CAST(s AS DOUBLE), 6) AS score, CAST({thr} AS DOUBLE) AS threshold,
 CASE WHEN s {bad} {thr} THEN CASE WHEN s {bad} {thr} * {worse} THEN 'FAIL' ELSE 'WARN' END ELSE 'PASS' END AS status FROM (SELECT CAST({score} AS DOUBLE) AS s)"""


def _told(name, cat, score, status="'PASS'"):
    return f"SELECT '{name}', '{cat}', round(CAST(s AS DOUBLE), 6), CAST(NULL AS DOUBLE), {status} FROM (SELECT CAST({score} AS DOUBLE) AS s)"


def _dup():
    return "(SELECT count(*) FROM (SELECT 1 FROM nodes WHERE content_hash IS NOT NULL AND status = 'active' GROUP BY content_hash HAVING count(*) > 1))"


@query("qc01_data_integrity", "QC0 QC1 AG2 AG4 JN6", "nodes edges", " UNION ALL ".join([
    _check("null_layer_pct", "data", f"(SELECT count(*) FROM nodes WHERE status = 'active' AND layer IS NULL AND type <> 'Unclassified') / {TOTAL}", 0, False),
    _check("content_hash_coverage", "data", f"(SELECT count(*) FROM nodes WHERE status = 'active' AND content_hash IS NOT NULL) / {TOTAL}", 0.95),
    _check("duplicate_content_hash_groups", "data", _dup(), 0), _check("duplicate_content_hash_groups_strict", "data", _dup(), 0, False),
    _told("deleted_node_edges_cleaned", "data", "(SELECT count(*) FROM edges WHERE status = 'active' AND (source_id IN (SELECT id FROM nodes WHERE status = 'deleted') OR target_id IN (SELECT id FROM nodes WHERE status = 'deleted')))", "CASE WHEN s = 0 THEN 'PASS' ELSE 'WARN' END"),
    _check("orphan_pct", "data", f"({ORPH}) / {TOTAL}", 0.10, False)]))
def qc01(t):
    return Q.data_integrity(t.nodes, t.edges)


_AN = "(SELECT count(*) FROM nodes WHERE status = 'active' AND {})"


@query("qc02_enrichment_coverage", "QC2 AG2", "nodes", " UNION ALL ".join([
    _check("enrichment_coverage", "enrichment", f"{_AN.format('coalesce(summary, chr(32)) NOT IN (chr(32), ' + chr(39) * 2 + ')')} / {TOTAL}", 0.6),
    _check("summary_null_pct", "enrichment", f"{_AN.format('nullif(summary, ' + chr(39) * 2 + ') IS NULL')} / {TOTAL}", 0.5, False),
    _check("key_concepts_null_pct", "enrichment", f"{_AN.format('len(key_concepts) = 0')} / {TOTAL}", 0.5, False),
    _check("domains_null_pct", "enrichment", f"{_AN.format('len(domains) = 0')} / {TOTAL}", 0.5, False),
    _check("quality_score_positive_pct", "enrichment", f"{_AN.format('quality_score > 0')} / {TOTAL}", 0.3)]))
def qc02(t):
    return Q.enrichment_coverage(t.nodes)


@query("qc03_graph_health", "QC3 AG5 AG6", "nodes edges", " UNION ALL ".join([
    _told("edge_counts", "graph", "(SELECT count(*) FROM edges WHERE status = 'active')").replace("SELECT 'edge_counts', 'graph', round(CAST(s AS DOUBLE), 6), CAST(NULL AS DOUBLE), 'PASS'", "SELECT 'edge_counts' AS name, 'graph' AS category, round(CAST(s AS DOUBLE), 6) AS score, CAST(NULL AS DOUBLE) AS threshold, 'PASS' AS status"),
    _told("orphan_nodes", "graph", f"({ORPH})", f"CASE WHEN s / {TOTAL} < 0.15 THEN 'PASS' ELSE 'WARN' END"),
    _told("avg_edge_strength", "graph", "(SELECT avg(strength) FROM edges WHERE status = 'active')"),
    _check("connected_nodes_pct", "graph", f"(SELECT count(DISTINCT n.id) FROM nodes n JOIN edges e ON e.status = 'active' AND (e.source_id = n.id OR e.target_id = n.id) WHERE n.status = 'active') / {TOTAL}", 0.85)]))
def qc03(t):
    return Q.graph_health(t.nodes, t.edges)


@query("qc04_distributions", "QC4 AG1", "nodes edges", """SELECT 'type' AS kind, value, n FROM (SELECT type AS value, count(*) AS n FROM nodes WHERE status = 'active' GROUP BY 1 ORDER BY n DESC, value LIMIT 20)
UNION ALL SELECT 'relation', value, n FROM (SELECT relation AS value, count(*) AS n FROM edges WHERE status = 'active' GROUP BY 1 ORDER BY n DESC, value LIMIT 20)
UNION ALL SELECT 'layer', CAST(layer AS VARCHAR), count(*) FROM nodes WHERE status = 'active' GROUP BY layer
UNION ALL SELECT 'project', value, n FROM (SELECT project AS value, count(*) AS n FROM nodes WHERE status = 'active' GROUP BY 1 ORDER BY n DESC, value LIMIT 10)""")
def qc04(t):
    n, e = G.active(t.nodes), G.active(t.edges)
    parts = [("type", Q.distribution(n, "type", 20)), ("relation", Q.distribution(e, "relation", 20)),
             ("layer", Q.distribution(n, "layer")), ("project", Q.distribution(n, "project", 10))]
    out = None
    for kind, df in parts:
        rows = df.select(F.lit(kind).alias("kind"), "value", "n")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("qc04_unused_names", "QC4 SO4 JN17", "nodes edges", f"""SELECT 'type' AS kind, x AS value FROM (SELECT unnest([{quoted(O.ACTIVE_TYPES)}]) AS x) WHERE x NOT IN (SELECT type FROM nodes WHERE status = 'active')
UNION ALL SELECT 'relation', x FROM (SELECT DISTINCT unnest([{quoted(O.SCHEMA_RELATIONS)}]) AS x) WHERE x NOT IN (SELECT relation FROM edges WHERE status = 'active')""")
def qc04_unused(t):
    a = Q.unused(G.active(t.nodes), "type", O.ACTIVE_TYPES).select(F.lit("type").alias("kind"), "value")
    return a.unionAll(Q.unused(G.active(t.edges), "relation", O.SCHEMA_RELATIONS).select(F.lit("relation").alias("kind"), "value"))


@query("qc05_schema_differences", "QC5 SO4 JN17", "nodes edges", f"""WITH d AS (SELECT DISTINCT unnest([{quoted(O.SCHEMA_RELATIONS)}]) AS name), s AS (SELECT DISTINCT relation AS name FROM edges)
SELECT name, 'declared_only' AS side FROM (SELECT * FROM d EXCEPT SELECT * FROM s) UNION ALL SELECT name, 'stored_only' FROM (SELECT * FROM s EXCEPT SELECT * FROM d)""")
def qc05(t):
    declared = t.spark.createDataFrame([(r,) for r in O.SCHEMA_RELATIONS], "name string")
    return Q.set_difference(declared, t.edges.select(F.col("relation").alias("name")).distinct())


@query("qc06_promotion_checks", "QC6", "nodes", " UNION ALL ".join([
    "SELECT 'signal_nodes_exist' AS name, 'promotion' AS category, round(CAST(s AS DOUBLE), 6) AS score, CAST(NULL AS DOUBLE) AS threshold, CASE WHEN s > 0 THEN 'PASS' ELSE 'WARN' END AS status FROM (SELECT count(*) AS s FROM nodes WHERE status = 'active' AND type = 'Signal')",
    _told("valid_promotions_layer_check", "promotion", "0"), _told("promotion_candidates", "promotion", "(SELECT count(*) FROM nodes WHERE status = 'active' AND promotion_candidate = 1)"),
    _told("l4_l5_access_control", "promotion", "1")]))
def qc06(t):
    return Q.promotion_checks(t.nodes)


@query("qc06_layer_steps", "QC6 RP11", "nodes edges", """SELECT s.layer AS source_layer, t.layer AS target_layer, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id
WHERE e.status = 'active' AND s.layer < t.layer GROUP BY ALL""")
def qc06_steps(t):
    return Q.layer_steps(t.edges, t.nodes)


@query("rp01_health_snapshot", "RP1 FLT10 SO2", "nodes edges", f"""WITH {LIVE} SELECT (SELECT count(*) FROM nodes WHERE status = 'active') AS active_nodes, (SELECT count(*) FROM nodes WHERE status = 'archived') AS archived_nodes,
 (SELECT count(*) FROM nodes WHERE status = 'active' AND trim(summary) <> '') AS summary_present, (SELECT count(*) FROM nodes WHERE status = 'active' AND len(key_concepts) > 0) AS key_concepts_present,
 (SELECT count(*) FROM nodes WHERE status = 'active' AND visit_count = 0 AND created_at <= {NOW} - INTERVAL 30 DAY) AS stale_zero_visit_created_30d,
 (SELECT count(*) FROM nodes WHERE status = 'active' AND visit_count = 0 AND (updated_at IS NULL OR updated_at <= {NOW} - INTERVAL 30 DAY)) AS stale_zero_visit_updated_30d,
 (SELECT count(*) FROM edges WHERE status = 'active') AS active_edges, (SELECT count(*) FROM edges WHERE status = 'active' AND trim(coalesce(description, '')) IN ('', '[]')) AS blank_edge_desc,
 (SELECT count(*) FROM live) AS active_active_edges,
 (SELECT count(*) FROM edges e LEFT JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes t ON t.id = e.target_id WHERE e.status = 'active' AND (coalesce(s.status, 'missing') <> 'active' OR coalesce(t.status, 'missing') <> 'active')) AS stale_active_edges,
 (SELECT count(*) FROM nodes WHERE status = 'active' AND id NOT IN (SELECT source_id FROM live UNION SELECT target_id FROM live)) AS true_orphans""")
def rp01(t):
    return Q.health_snapshot(t.nodes, t.edges, AS_OF)


def _spread(c):
    return f"""SELECT '{c}' AS field, type, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, count(*) FILTER (v = 0) AS zeros
FROM (SELECT type, CAST(coalesce({c}, 0) AS DOUBLE) AS v FROM nodes WHERE status = 'active') GROUP BY type"""


@query("rp02_growth_audit", "RP2 AG8", "nodes", f"{_spread('maturity')} UNION ALL {_spread('observation_count')}")
def rp02(t):
    parts = [Q.spread_by_type(t.nodes, c).withColumn("field", F.lit(c)) for c in ("maturity", "observation_count")]
    return parts[0].unionByName(parts[1])


@query("rp02_visit_growth_correlation", "RP2 AG9", "nodes", "SELECT count(*) AS n, round(corr(CAST(visit_count AS DOUBLE), maturity), 6) AS correlation FROM nodes WHERE status = 'active' AND maturity IS NOT NULL")
def rp02_corr(t):
    return Q.correlation(G.active(t.nodes).where("maturity IS NOT NULL"), "visit_count", "maturity")


@query("rp02_dead_fields", "RP2 AG6", "nodes", """SELECT count(*) AS total_active, count(*) FILTER (maturity = 0) AS zero_maturity, round(count(*) FILTER (maturity = 0) / count(*) * 100, 6) AS zero_maturity_pct,
 count(*) FILTER (observation_count = 0) AS zero_observation, round(count(*) FILTER (observation_count = 0) / count(*) * 100, 6) AS zero_observation_pct FROM nodes WHERE status = 'active'""")
def rp02_dead(t):
    return Q.dead_fields(t.nodes)


@query("rp03_feedback_rates", "RP3", "feedback_events", f"""SELECT count(*) AS total, round(count(*) FILTER (feedback_type = 'reject') / count(*), 6) AS reject_rate, round(count(*) FILTER (feedback_type = 'approve') / count(*), 6) AS approve_rate
FROM feedback_events WHERE created_at >= {NOW} - INTERVAL 110 DAY""")
def rp03(t):
    return Q.feedback_rates(t.feedback_events, AS_OF, 110)


@query("rp03_retrieval_stats", "RP3 AG5", "retrieval_logs", f"""SELECT count(*) AS total_retrievals, count(DISTINCT nullif(session_id, '')) AS unique_sessions, round(count(*) FILTER (cross_domain = 1) / count(*), 6) AS cross_domain_rate,
 round(count(*) FILTER (feedback_linked = 1) / count(*), 6) AS feedback_linked_rate FROM retrieval_logs WHERE created_at >= {NOW} - INTERVAL 110 DAY""")
def rp03_stats(t):
    return Q.retrieval_stats(t.retrieval_logs, AS_OF, 110)


@query("rp03_slot_averages", "RP3 AG13", "retrieval_logs", f"""WITH s AS (SELECT * FROM retrieval_logs WHERE created_at >= {NOW} - INTERVAL 110 DAY AND slot_distribution <> '{{}}' ORDER BY created_at DESC, id DESC LIMIT 500),
v AS (SELECT slot_distribution AS j FROM s WHERE json_valid(slot_distribution))
SELECT 'Decision' AS slot, round(CAST(sum(CAST(j::JSON->>'Decision' AS INTEGER)) AS DOUBLE) / count(*), 6) AS slot_avg FROM v UNION ALL SELECT 'Signal', round(CAST(sum(CAST(j::JSON->>'Signal' AS INTEGER)) AS DOUBLE) / count(*), 6) FROM v""")
def rp03_slots(t):
    return Q.slot_averages(t.retrieval_logs, AS_OF, 110)


@query("rp03_open_conflicts", "RP3", "trait_conflicts", "SELECT coalesce(conflicting_source_type, 'null') AS source, count(*) AS n FROM trait_conflicts WHERE resolved = 0 GROUP BY 1")
def rp03_conflicts(t):
    return Q.open_conflicts_by_source(t.trait_conflicts)


@query("rp03_stale_policies", "RP3", "traits", f"""SELECT 'rule_' || id AS name, 'trait status=' || status || ' approval=' || approval AS reason FROM traits
WHERE (status IN ('provisional', 'archived') OR approval IN ('pending', 'rejected', 'expired')) AND coalesce(verified_at, TIMESTAMP '2024-01-01') < {NOW} - INTERVAL 30 DAY""")
def rp03_stale(t):
    rules = t.traits.select(F.concat(F.lit("rule_"), "id").alias("name"), F.col("id").alias("trait_id"),
                            F.coalesce("verified_at", F.lit("2024-01-01").cast("timestamp_ntz")).alias("compiled_at"))
    return Q.stale_policies(rules, t.traits, AS_OF, 30)


@query("rp04_daily_counts", "RP4 AG15", "nodes", f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM nodes WHERE status = 'active' AND created_at > {NOW} - INTERVAL 7 DAY GROUP BY 1")
def rp04(t):
    return Q.daily_counts(t.nodes, AS_OF)


@query("rp05_dashboard_counts", "RP5 RP4 AG1", "nodes", """SELECT coalesce(nullif(project, ''), '(none)') AS project, type, count(*) AS n, round(avg(quality_score), 6) AS quality FROM nodes WHERE status = 'active' GROUP BY ALL""")
def rp05(t):
    return G.active(t.nodes).groupBy(F.coalesce(F.nullif("project", F.lit("")), F.lit("(none)")).alias("project"), "type").agg(
        F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("quality"))


@query("rp06_state_metrics", "RP6 AG2 AG3", "nodes edges", f"""WITH {LIVE} SELECT count(*) AS active_nodes, count(*) FILTER (type = 'Signal') AS signal, count(*) FILTER (type = 'Correction') AS correction, count(*) FILTER (epistemic_status = 'validated') AS validated,
 count(*) FILTER (node_role = 'knowledge_core') AS knowledge_core, round(avg(maturity), 6) AS maturity_avg, min(maturity) AS maturity_min, max(maturity) AS maturity_max, count(*) FILTER (maturity = 0) AS zero_maturity,
 count(*) FILTER (observation_count > 0) AS observation_nonzero, max(observation_count) AS observation_max,
 (SELECT count(*) FROM edges WHERE status = 'active') AS active_edges, (SELECT count(*) FROM edges WHERE status = 'active' AND relation = 'contradicts') AS contradicts,
 (SELECT round(1 - count(*) FILTER (trim(coalesce(direction, '')) = '') / count(*), 6) FROM edges WHERE status = 'active') AS direction_ratio,
 (SELECT count(*) FROM edges WHERE status = 'active' AND generation_method <> '' AND generation_method NOT IN ({quoted(O.GENERATION_METHODS)})) AS drift_edges,
 (SELECT count(*) FROM live l JOIN nodes s ON s.id = l.source_id JOIN nodes t ON t.id = l.target_id WHERE s.project <> t.project) AS cross_domain FROM nodes WHERE status = 'active'""")
def rp06(t):
    return Q.state_metrics(t.nodes, t.edges)


@query("rp07_saturation", "RP7 AG16", "nodes", """SELECT unnest(['summary', 'content_hash', 'source_kind', 'retrieval_hints']) AS field, unnest([a, b, c, d]) AS filled, n AS total, round(unnest([a, b, c, d]) / n, 6) AS ratio
FROM (SELECT count(*) AS n, count(*) FILTER (summary <> '') AS a, count(*) FILTER (content_hash <> '') AS b, count(*) FILTER (source_kind <> '') AS c, count(*) FILTER (retrieval_hints <> '') AS d FROM nodes WHERE status = 'active')""")
def rp07(t):
    return Q.filled_ratio(G.active(t.nodes), ["summary", "content_hash", "source_kind", "retrieval_hints"])


@query("rp08_proven_knowledge", "RP8 SO5", "nodes", """WITH a AS (SELECT * FROM nodes WHERE status = 'active'), u AS (SELECT id, 0 AS prio, 'knowledge_core' AS reason FROM a WHERE node_role = 'knowledge_core'
UNION ALL SELECT id, 1, 'validated' FROM a WHERE epistemic_status = 'validated' AND quality_score >= 0.85
UNION ALL SELECT * FROM (SELECT id, 2, 'high_signal' FROM a WHERE type = 'Signal' AND visit_count >= 5 ORDER BY visit_count DESC, quality_score DESC NULLS LAST, id LIMIT 15)
UNION ALL SELECT * FROM (SELECT id, 3, 'correction' FROM a WHERE type = 'Correction' ORDER BY created_at DESC, id LIMIT 10))
SELECT id, min(prio) AS prio, arg_min(reason, prio) AS reason FROM u GROUP BY id""")
def rp08(t):
    return Q.proven_knowledge(t.nodes)


@query("rp09_memory_digest", "RP9", "nodes", f"""WITH a AS (SELECT *, substr(content, 1, 80) AS preview FROM nodes WHERE status = 'active'), k AS (SELECT * FROM a WHERE node_role NOT IN ('external_noise', 'work_item'))
SELECT 'core' AS section, id, preview FROM k WHERE layer = 3 AND epistemic_status <> 'outdated'
UNION ALL SELECT * FROM (SELECT 'structural', id, preview FROM k WHERE layer = 2 AND epistemic_status <> 'outdated' ORDER BY coalesce(quality_score, 0.65) DESC, id LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'decisions', id, preview FROM k WHERE type = 'Decision' AND created_at >= {NOW} - INTERVAL 7 DAY ORDER BY created_at DESC, id LIMIT 5)
UNION ALL SELECT 'questions', id, preview FROM k WHERE type = 'Question'
UNION ALL SELECT * FROM (SELECT 'failures', id, preview FROM a WHERE type = 'Failure' ORDER BY created_at DESC, id LIMIT 3)""")
def rp09(t):
    return Q.memory_digest(t.nodes, AS_OF)


@query("rp10_interaction_audit", "RP10", "nodes recall_log", "SELECT r.query, n.type, count(*) AS n, count(DISTINCT r.recall_id) AS recalls FROM recall_log r JOIN nodes n ON n.id = r.node_id GROUP BY ALL")
def rp10(t):
    hits = t.recall_log.join(t.nodes.select(F.col("id").alias("node_id"), "type"), "node_id")
    return hits.groupBy("query", "type").agg(F.count("*").alias("n"), F.count_distinct("recall_id").alias("recalls"))


@query("rp11_memory_audit", "RP11", "nodes", """SELECT 'quality' AS measure, min(quality_score) AS least, max(quality_score) AS most, round(avg(quality_score), 6) AS mean, quantile_cont(quality_score, 0.5) AS median FROM nodes WHERE status = 'active'
UNION ALL SELECT 'content_length', min(l), max(l), round(avg(l), 6), quantile_cont(l, 0.5) FROM (SELECT CAST(length(content) AS DOUBLE) AS l FROM nodes WHERE status = 'active')""")
def rp11(t):
    return Q.memory_audit(t.nodes)


@query("rp12_safety_net", "RP12", "nodes", f"SELECT count(*) FILTER (created_at > {NOW} - INTERVAL 48 HOUR) AS saved_recently, count(*) FILTER (type = 'Question' AND status = 'active') AS open_questions FROM nodes")
def rp12(t):
    return Q.safety_net(t.nodes, AS_OF, 48)


@query("ag11_embedding_stability", "AG11", "", """WITH s AS (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS stdev, round(avg(s) - 2 * stddev_samp(s), 6) AS suggested FROM s""")
def ag11(t):
    b = t.embeddings.selectExpr("id - 1 AS id", "embedding AS b")
    return Q.stability(t.embeddings.join(b, "id").select(cosine(F.col("embedding"), F.col("b")).alias("s")), "s")


# --- ranking evaluation ----------------------------------------------------

RUN = """run AS (SELECT qid, node_id, rank FROM (SELECT user_id AS qid, node_id, row_number() OVER (PARTITION BY user_id ORDER BY max(round(score, 9)) DESC, node_id) AS rank FROM recall_log GROUP BY user_id, node_id) WHERE rank <= 10)"""
NDCG = """gr AS (SELECT r.qid, r.rank, coalesce(g.grade, 0) AS g FROM run r LEFT JOIN goldset g ON g.qid = r.qid AND g.node_id = r.node_id),
idl AS (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, node_id) AS rank FROM goldset),
dc AS (SELECT q.qid, k, coalesce((SELECT sum(g / log2(rank + 1)) FROM gr WHERE gr.qid = q.qid AND rank <= k), 0) AS dcg, (SELECT sum(grade / log2(rank + 1)) FROM idl WHERE idl.qid = q.qid AND rank <= k) AS idcg
 FROM (SELECT DISTINCT qid FROM goldset) q, (VALUES (5), (10)) v(k))"""


def _run(t):
    return E.ranking(t.recall_log.select(F.col("user_id").alias("qid"), "node_id", F.round("score", 9).alias("score")), 10)


@query("ev01_ndcg", "EV1", "goldset recall_log", f"WITH {RUN}, {NDCG} SELECT qid, k, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM dc")
def ev01(t):
    return E.ndcg(_run(t), t.goldset, [5, 10])


@query("ev02_hit_rates", "EV2", "goldset recall_log", f"""WITH {RUN} SELECT round(avg(CASE WHEN any_hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(part), 6) AS relevant_share FROM (SELECT g.qid, bool_or(r.node_id IS NOT NULL) AS any_hit,
 coalesce(CAST(count(r.node_id) FILTER (g.grade = 1) AS DOUBLE) / nullif(count(*) FILTER (g.grade = 1), 0), 0) AS part FROM goldset g LEFT JOIN run r ON r.qid = g.qid AND r.node_id = g.node_id GROUP BY g.qid)""")
def ev02(t):
    return E.hit_rates(_run(t), t.goldset)


@query("ev03_rrf_sweep", "EV3", "goldset recall_log", """WITH c AS (SELECT user_id AS qid, node_id, row_number() OVER (PARTITION BY user_id ORDER BY max(round(score, 9)) DESC, node_id) AS r1, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, node_id) AS r2 FROM recall_log GROUP BY 1, 2),
f AS (SELECT k, qid, node_id, row_number() OVER (PARTITION BY k, qid ORDER BY round(CASE WHEN r1 <= 20 THEN CAST(1 AS DOUBLE) / (k + r1) ELSE 0 END + CASE WHEN r2 <= 20 THEN CAST(1 AS DOUBLE) / (k + r2) ELSE 0 END, 9) DESC, node_id) AS rank FROM c, (VALUES (5), (18), (60)) v(k) WHERE r1 <= 20 OR r2 <= 20),
gr AS (SELECT f.k, f.qid, sum(coalesce(g.grade, 0) / log2(f.rank + 1)) AS dcg FROM f LEFT JOIN goldset g ON g.qid = f.qid AND g.node_id = f.node_id WHERE f.rank <= 10 GROUP BY 1, 2),
idl AS (SELECT qid, sum(grade / log2(rank + 1)) AS idcg FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, node_id) AS rank FROM goldset) WHERE rank <= 10 GROUP BY qid)
SELECT gr.k AS rrf_k, round(avg(dcg / idcg), 6) AS ndcg FROM gr JOIN idl ON idl.qid = gr.qid GROUP BY gr.k""")
def ev03(t):
    log = t.recall_log.groupBy(F.col("user_id").alias("qid"), "node_id").agg(F.max(F.round("score", 9)).alias("best"), F.count("*").alias("n"))
    a = E.ranking(log.select("qid", "node_id", F.col("best").alias("score")), 20)
    b = E.ranking(log.select("qid", "node_id", F.col("n").cast("double").alias("score")), 20)
    return E.rrf_sweep([a, b], t.goldset, [5, 18, 60], 10)


@query("ev04_zero_result_queries", "EV4 QC8", "goldset recall_log", f"WITH {RUN} SELECT DISTINCT qid FROM goldset WHERE qid NOT IN (SELECT g.qid FROM goldset g JOIN run r ON r.qid = g.qid AND r.node_id = g.node_id AND r.rank <= 5)")
def ev04(t):
    return E.zero_result_queries(_run(t), t.goldset, 5)


@query("qc08_search_quality", "QC8", "goldset recall_log", f"""WITH {RUN}, {NDCG}, m AS (SELECT avg(CASE WHEN k = 5 THEN dcg / idcg END) AS n5, avg(CASE WHEN k = 10 THEN dcg / idcg END) AS n10 FROM dc),
h AS (SELECT avg(CASE WHEN x THEN 1.0 ELSE 0.0 END) AS hr FROM (SELECT g.qid, bool_or(r.node_id IS NOT NULL) AS x FROM goldset g LEFT JOIN run r ON r.qid = g.qid AND r.node_id = g.node_id GROUP BY g.qid))
{_check('ndcg@5', 'search', '(SELECT n5 FROM m)', 0.25)} UNION ALL {_check('ndcg@10', 'search', '(SELECT n10 FROM m)', 0.3)} UNION ALL {_check('hit_rate', 'search', '(SELECT hr FROM h)', 0.5)}""")
def qc08(t):
    return E.quality_checks(_run(t), t.goldset)


@query("ev05_candidate_pool", "EV5 SO5", "recall_log", """WITH c AS (SELECT user_id AS qid, node_id, row_number() OVER (PARTITION BY user_id ORDER BY max(round(score, 9)) DESC, node_id) AS r1, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, node_id) AS r2 FROM recall_log GROUP BY 1, 2)
SELECT qid, node_id, CASE WHEN r1 <= 3 THEN 'best' ELSE 'often' END AS source FROM c WHERE r1 <= 3 OR r2 <= 3""")
def ev05(t):
    log = t.recall_log.groupBy(F.col("user_id").alias("qid"), "node_id").agg(F.max(F.round("score", 9)).alias("best"), F.count("*").alias("n"))
    a = E.ranking(log.select("qid", "node_id", F.col("best").alias("score")), 3)
    b = E.ranking(log.select("qid", "node_id", F.col("n").cast("double").alias("score")), 3)
    return E.pool([("best", a), ("often", b)])
