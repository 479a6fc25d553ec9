"""Clean-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.fixtures import AS_OF
from loomgraph.operators import curation as C
from loomgraph.operators import graph as G
from loomgraph.plans.registry import query
from loomgraph.plans.sqlparts import LIVE, NOW, RULES, ends, quoted

STALE = f"status = 'active' AND coalesce(visit_count, 0) = 0 AND created_at < {NOW} - INTERVAL 30 DAY AND node_role <> 'knowledge_core' AND epistemic_status <> 'validated'"


@query("cu01_stale_duplicates", "CU1 FLT4 WN6 TK4", "nodes", f"""WITH p AS (SELECT id, project, type, source, sha1(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS content_key,
 CASE WHEN lower(source) LIKE '%!_archived%' ESCAPE '!' OR lower(source) LIKE '%changelog.md%' THEN 1 ELSE 0 END AS a FROM nodes
 WHERE {STALE} AND source LIKE 'obsidian:%' AND source NOT IN ('obsidian:AGENTS.md') AND NOT starts_with(source, 'obsidian:.rulesync\\') AND trim(content) <> ''),
w AS (SELECT *, count(*) OVER g AS group_size, first_value(id) OVER (PARTITION BY project, type, content_key ORDER BY a, length(source), id) AS keep_id FROM p WINDOW g AS (PARTITION BY project, type, content_key))
SELECT project, type, content_key, group_size, keep_id, id, CASE WHEN id = keep_id THEN 'keep' ELSE 'archive' END AS action FROM w WHERE group_size > 1""")
def cu01(t):
    return C.stale_duplicates(t.nodes, AS_OF)


@query("cu02_same_source_duplicates", "CU2 WN6", "nodes", """WITH p AS (SELECT *, sha1(trim(coalesce(content, ''))) AS content_key FROM nodes WHERE status = 'active'),
w AS (SELECT *, count(*) OVER (PARTITION BY source, content_key) AS group_size, first_value(id) OVER (PARTITION BY source, content_key ORDER BY coalesce(visit_count, 0) DESC, coalesce(quality_score, 0) DESC, id) AS keep_id FROM p)
SELECT source, content_key, group_size, keep_id, id, CASE WHEN id = keep_id THEN 'keep' ELSE 'archive' END AS action FROM w WHERE group_size > 1""")
def cu02(t):
    return C.same_source_duplicates(t.nodes)


@query("cu03_stale_history", "CU3 FLT4", "nodes", f"""SELECT id, source, CASE source WHEN 'obsidian:notes\\_history\\log.md' THEN 'obsidian_history' WHEN 'obsidian:notes\\_archived\\old.md' THEN 'obsidian_archived' ELSE 'obsidian_changelog' END AS rule
FROM nodes WHERE {STALE} AND source IN ('obsidian:notes\\_history\\log.md', 'obsidian:notes\\_archived\\old.md', 'obsidian:CHANGELOG.md')""")
def cu03(t):
    return C.stale_history(t.nodes, AS_OF)


_TASK = "|".join(["(^|\\n)##\\s*Task\\b", "\\*\\*Files:\\*\\*", "(^|\\n)\\*\\*Step\\s+\\d+", "(^|\\n)\\s*[-*]\\s*(Create|Modify|Delete|Rename):", "`C:\\\\dev\\\\"])


@query("cu04_stale_plan_tasks", "CU4 FLT11", "nodes", f"""SELECT id, source, regexp_matches(content, '(?i){_TASK}') AS taskish FROM nodes WHERE {STALE} AND source LIKE 'obsidian:%plans%' AND trim(content) <> ''
UNION ALL SELECT id, source, regexp_matches(content, '(?i){_TASK}|```(bash|tsx|html|yaml|typescript|javascript|liquid)') FROM nodes WHERE {STALE} AND source LIKE 'obsidian:%03_tech-review%impl%.md%' AND trim(content) <> ''""")
def cu04(t):
    plans = C.stale_plan_tasks(t.nodes, AS_OF)
    return plans.unionAll(C.stale_plan_tasks(t.nodes, AS_OF, source_like="obsidian:%03_tech-review%impl%.md%",
                                             patterns=[*C.TASK_PATTERNS, C.FENCED_CODE]))


@query("cu05_retention_policy", "CU5 FLT15", "nodes", f"""SELECT id, source, type, 'reference_notes' AS rule_label FROM nodes WHERE {STALE} AND source NOT IN ('checkpoint', 'claude') AND source = 'obsidian:notes\\daily.md'
UNION ALL SELECT id, source, type, 'tool_cookbook' FROM nodes WHERE {STALE} AND source NOT IN ('checkpoint', 'claude') AND type = 'Tool'""")
def cu05(t):
    keep = {"hot_capture_keep": F.col("source").isin("checkpoint", "claude")}
    rules = {"reference_notes": F.col("source") == "obsidian:notes\\daily.md", "tool_cookbook": F.col("type") == "Tool"}
    return C.retention(t.nodes, AS_OF, 30, keep, rules)


@query("cu06_orphan_control_docs", "CU6 JN7", "nodes edges", f"""WITH {LIVE} SELECT id, project, source, type, substr(replace(content, chr(10), ' '), 1, 160) AS preview FROM nodes WHERE status = 'active' AND coalesce(visit_count, 0) = 0
 AND created_at <= {NOW} - INTERVAL 30 DAY AND (starts_with(source, 'obsidian:.rulesync\\') OR starts_with(source, 'obsidian:notes\\')) AND id NOT IN (SELECT source_id FROM live UNION SELECT target_id FROM live)""")
def cu06(t):
    return C.orphan_control_docs(t.nodes, t.edges, AS_OF, ["obsidian:.rulesync\\", "obsidian:notes\\"])


_TACT, _STRONG, _DUR = ("|".join(x) for x in (C.TACTICAL, C.STRONG_TACTICAL, C.DURABLE))


@query("cu07_session_items", "CU7 FLT13 FLT14", "nodes", f"""WITH b AS (SELECT id, type, trim(content) AS x, lower(trim(content)) AS lo, regexp_matches(content, '{C.FILE_HINT}') AS hint FROM nodes WHERE status = 'active' AND type IN ('Decision', 'Question')),
f AS (SELECT *, regexp_matches(lo, '{_TACT}') OR hint AS ta, regexp_matches(lo, '{_STRONG}') OR hint AS st, regexp_matches(regexp_replace(lo, '{C.FILE_HINT}', ' ', 'g'), '{_DUR}') AS du FROM b)
SELECT id, CASE WHEN length(x) < 40 OR (type = 'Question' AND ta AND NOT du) OR (st AND NOT du) OR (length(x) < CASE type WHEN 'Question' THEN 90 ELSE 70 END AND ta AND NOT du) THEN 'work_item' ELSE 'knowledge_candidate' END AS role,
 x = '' OR regexp_matches(x, '{"|".join(O.SKIP_PATTERNS)}') AS skipped FROM f""")
def cu07(t):
    items = G.active(t.nodes).where(F.col("type").isin("Decision", "Question"))
    return items.select("id", C.item_role(F.col("content"), F.col("type")).alias("role"), C.skip_item(F.col("content")).alias("skipped"))


@query("cu08_hook_nodes", "CU8", "nodes", "SELECT id, source, type, node_role FROM nodes WHERE status = 'active' AND project = 'src3' AND source_kind = 'hook'")
def cu08(t):
    return C.hook_nodes(t.nodes, "src3")


@query("cu07_session_work_items", "CU7", "nodes", "SELECT id, type, project, length(trim(content)) AS content_len FROM nodes WHERE status = 'active' AND source = 'save_session' AND node_role = 'work_item' AND type IN ('Decision', 'Question')")
def cu07_items(t):
    return C.session_items(t.nodes, "work_item").select("id", "type", "project", F.length(F.trim("content")).cast("bigint").alias("content_len"))


@query("cu09_edges_touching_inactive", "CU9 JN10", "nodes edges", """SELECT e.id, e.source_id, e.target_id, e.relation FROM edges e WHERE e.status = 'active'
 AND EXISTS (SELECT 1 FROM nodes n WHERE n.status <> 'active' AND n.id IN (e.source_id, e.target_id))""")
def cu09(t):
    return C.edges_touching_inactive(t.nodes, t.edges)


@query("cu10_normalise_relations", "CU10 FLT18", "nodes edges", f"""SELECT e.id, e.relation AS old_relation, CASE e.relation WHEN 'realizes' THEN CASE WHEN s.layer < t.layer THEN 'realized_as' ELSE 'expressed_as' END WHEN 'influences' THEN 'correlated_with' END AS new_relation, e.source_id, e.target_id
FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.status = 'active' AND e.relation IN ('realizes', 'influences')""")
def cu10(t):
    return C.normalise_relations(t.nodes, t.edges, O.SCHEMA_RELATIONS)


AUDIT = f"""{RULES}, act AS (SELECT * FROM edges WHERE status = 'active'), {ends('act')}, dg AS (SELECT nid, count(*) AS d FROM ends GROUP BY nid),
au AS (SELECT e.id, e.source_id, e.target_id, coalesce(e.strength, 0) AS s, EXISTS (SELECT 1 FROM rules r WHERE (r.st = a.type AND r.tt = b.type) OR (r.st = b.type AND r.tt = a.type)) AS typed, a.project = b.project AS same, x.d AS d1, y.d AS d2
 FROM act e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id JOIN dg x ON x.nid = e.source_id JOIN dg y ON y.nid = e.target_id WHERE e.generation_method = 'orphan_repair'),
dec AS (SELECT *, CASE WHEN s < 0.15 THEN 'ultra-weak' WHEN s < 0.3 AND NOT typed THEN 'weak + untyped' END AS reason FROM au),
fin AS (SELECT *, CASE WHEN reason IS NULL THEN 'keep' WHEN d1 <= 1 OR d2 <= 1 THEN 'protected' ELSE 'delete' END AS decision FROM dec)"""


@query("cu11_repair_edge_audit", "CU11", "nodes edges", f"""WITH {AUDIT} SELECT id, CASE WHEN s < 0.3 THEN 'weak' WHEN s < 0.5 THEN 'marginal' ELSE 'ok' END AS strength_bucket, CASE WHEN typed THEN 'typed' ELSE 'untyped' END AS type_bucket,
 CASE WHEN same THEN 'same_project' ELSE 'cross_project' END AS project_bucket, reason, decision FROM fin""")
def cu11(t):
    return C.audit_repair_edges(t.nodes, t.edges)


@query("cu11_orphans_after_deletion", "CU11", "nodes edges", f"""WITH {AUDIT}, rest AS (SELECT * FROM act WHERE id NOT IN (SELECT id FROM fin WHERE decision = 'delete'))
SELECT id FROM nodes WHERE status = 'active' AND id NOT IN (SELECT source_id FROM rest UNION SELECT target_id FROM rest)""")
def cu11_after(t):
    gone = C.audit_repair_edges(t.nodes, t.edges).where("decision = 'delete'")
    return C.orphans_after(t.nodes, t.edges, gone)


@query("cu12_undo_evaluation", "CU12 AG17", "nodes recall_log", """SELECT n.id, h.c AS eval_hits, coalesce(visit_count, 0) AS visits_before, greatest(coalesce(visit_count, 0) - h.c, 0) AS visits_after
FROM nodes n JOIN (SELECT node_id, count(*) AS c FROM recall_log WHERE query IN ('view', 'purchase') GROUP BY node_id) h ON h.node_id = n.id""")
def cu12(t):
    return C.undo_evaluation(t.nodes, t.recall_log, ["view", "purchase"])


@query("cu12_undo_evaluation_totals", "CU12 AG17 SNK5", "nodes recall_log", """WITH p AS (SELECT * FROM recall_log WHERE query IN ('view', 'signup')), h AS (SELECT node_id, count(*) AS c FROM p GROUP BY node_id)
SELECT (SELECT count(*) FROM p) AS log_rows, (SELECT count(DISTINCT node_id) FROM p) AS nodes_hit, (SELECT count(DISTINCT recall_id) FROM p) AS recalls, (SELECT count(*) FROM p WHERE recall_id IS NULL) AS rows_without_recall,
 greatest(2000 - (SELECT count(DISTINCT recall_id) FROM p), 0) AS total_after, (SELECT CAST(sum(least(coalesce(n.visit_count, 0), h.c)) AS BIGINT) FROM nodes n JOIN h ON h.node_id = n.id) AS visit_delta""")
def cu12_totals(t):
    return C.undo_evaluation_totals(t.nodes, t.recall_log, ["view", "signup"], 2000)


@query("cu13_reset_edge_learning", "CU13", "edges", """SELECT id, CASE WHEN base_strength IS NOT NULL AND abs(coalesce(strength, 0) - base_strength) > 0.000001 THEN base_strength ELSE strength END AS strength, 0 AS frequency,
 coalesce(frequency, 0) <> 0 OR last_activated IS NOT NULL AS counter_reset, base_strength IS NOT NULL AND abs(coalesce(strength, 0) - coalesce(base_strength, 0)) > 0.000001 AS strength_restored
FROM edges WHERE status = 'active' AND (coalesce(frequency, 0) <> 0 OR last_activated IS NOT NULL OR (base_strength IS NOT NULL AND abs(coalesce(strength, 0) - base_strength) > 0.000001))""")
def cu13(t):
    return C.reset_edge_learning(t.edges)


@query("cu13_edge_learning_stats", "CU13 AG3", "edges", """SELECT count(*) AS active_edges, count(*) FILTER (frequency > 0) AS edges_with_frequency, CAST(sum(frequency) AS BIGINT) AS frequency_sum, count(last_activated) AS last_activated_nonnull,
 count(*) FILTER (base_strength IS NOT NULL AND abs(strength - base_strength) > 0.000001) AS strength_restore_candidates, count(*) FILTER (generation_method = 'co_retrieval') AS co_retrieval_active FROM edges WHERE status = 'active'""")
def cu13_stats(t):
    return C.edge_learning_stats(t.edges)


@query("cu14_vector_tombstones", "CU14 JN17", "nodes", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM nodes WHERE status = 'active')")
def cu14(t):
    return C.vector_tombstones(t.embeddings, t.nodes)


@query("cu15_hash_duplicates", "CU15 AG4", "nodes", "SELECT content_hash, count(*) AS copies, min(id) AS first_id FROM nodes WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1")
def cu15(t):
    return C.hash_duplicates(t.nodes)
