"""Context, task, event and trait queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.fixtures import AS_OF
from loomgraph.operators import context as C
from loomgraph.operators import tasks as K
from loomgraph.operators import traits as R
from loomgraph.plans.registry import query
from loomgraph.plans.sqlparts import NOW, quoted

_A = "SELECT * FROM nodes WHERE status = 'active'"


def _sec(name, where, order, limit, cols="summary", n=80):
    text = "coalesce(nullif(summary, ''), content)" if cols == "summary" else "content"
    return f"SELECT '{name}' AS section, id, preview FROM (SELECT id, substr({text}, 1, {n}) AS preview FROM a WHERE {where} ORDER BY {order}, id LIMIT {limit})"


_F = "epistemic_status NOT IN ('outdated', 'superseded', 'flagged')"
_P = "node_role NOT IN ('work_item', 'external_noise')"


@query("cx01_session_sections", "CX1 CX2 JN9 TK2 WN2", "nodes edges", f"WITH a AS ({_A}) " + " UNION ALL ".join([
    _sec("knowledge_core", f"node_role = 'knowledge_core' AND {_F}", "visit_count DESC NULLS LAST", 30, n=100),
    _sec("l2_core", f"layer >= 2 AND type IN ('Pattern', 'Insight', 'Principle', 'Identity', 'Framework') AND {_F} AND {_P}", "quality_score DESC NULLS LAST", 15),
    _sec("signals", f"type = 'Signal' AND created_at >= {NOW} - INTERVAL 30 DAY", "created_at DESC", 10),
    _sec("observations", f"type = 'Observation' AND created_at >= {NOW} - INTERVAL 7 DAY", "created_at DESC", 5),
    _sec("decisions", f"type = 'Decision' AND {_P}", "created_at DESC", 3, "content"), _sec("questions", f"type = 'Question' AND {_P}", "created_at DESC", 3, "content"),
    _sec("failures", "type = 'Failure'", "created_at DESC", 2, "content"), _sec("insights", "type = 'Insight'", "created_at DESC", 2, "content"),
    _sec("promotion_ready", "type IN ('Signal', 'Pattern', 'Observation') AND visit_count >= 5", "visit_count DESC", 3, "content"),
    "SELECT 'corrections', id, preview FROM (SELECT n.id, substr(n.content, 1, 80) AS preview FROM a n LEFT JOIN edges e ON e.source_id = n.id AND e.relation = 'contradicts' AND e.status = 'active' WHERE n.type = 'Correction' ORDER BY n.created_at DESC, n.id, e.target_id LIMIT 5)"]))
def cx01(t):
    return C.sections(t.nodes, t.edges, AS_OF)


@query("cx01_repeated_failures", "CX1 AG4", "nodes", f"SELECT project, count(*) AS failures FROM nodes WHERE status = 'active' AND type = 'Failure' AND created_at >= {NOW} - INTERVAL 90 DAY GROUP BY project HAVING count(*) >= 2 ORDER BY failures DESC, project LIMIT 3")
def cx01_failures(t):
    return C.repeated_failures(t.nodes, AS_OF, days=90, least=2)


@query("cx01_last_session", "CX1", "sessions", """SELECT session_id, substr(summary, 1, 200) AS summary, CASE WHEN active_pipeline <> '' THEN active_pipeline ELSE (SELECT active_pipeline FROM sessions WHERE active_pipeline <> '' ORDER BY id DESC LIMIT 1) END AS pipeline
FROM sessions ORDER BY id DESC LIMIT 1""")
def cx01_session(t):
    return C.last_session(t.sessions)


@query("st04_session_timeline", "ST4 CX1", "action_log", """SELECT id, strftime(created_at, '%H:%M') AS time, CASE action_type WHEN 'session_start' THEN 'session_start' ELSE replace(action_type, '_recorded', '') END AS type,
 params::JSON->>'type' AS node_type, substr(context, 1, 80) AS summary FROM action_log WHERE session_id = 's8' AND action_type IN ('decision_recorded', 'failure_recorded', 'question_recorded', 'session_start') ORDER BY created_at, id LIMIT 20""")
def st04(t):
    return C.timeline(t.action_log, "s8")


@query("cx03_principles", "CX3 WN2", "traits", """SELECT dimension, id, rn FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY verified_at DESC, id) AS rn FROM traits WHERE status = 'verified' AND approval = 'approved' AND dimension <> 'unclassified') WHERE rn <= 2""")
def cx03(t):
    return C.principles(t.traits).select("dimension", "id", "rn")


@query("cx03_episodes", "CX3", "captures sessions", """SELECT * FROM (SELECT 'message' AS kind, id, substr(content, 1, 200) AS content FROM captures WHERE actor = 'owner' AND length(content) > 10 ORDER BY created_at DESC, id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'session_summary', session_id, substr(summary, 1, 200) FROM sessions WHERE summary <> '' ORDER BY started_at DESC, sessions.id LIMIT 3)""")
def cx03_episodes(t):
    return C.episodes(t.captures, t.sessions)


PACK = f"""WITH rej AS (SELECT DISTINCT target_id FROM feedback_events WHERE feedback_type = 'reject' AND target_type = 'trait'),
pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY verified_at DESC, id) AS rn FROM traits WHERE status = 'verified' AND approval = 'approved' AND dimension <> 'unclassified') WHERE rn <= 2),
bo AS (SELECT * FROM traits WHERE status = 'verified' AND approval = 'approved' AND dimension IN ('preference', 'emotion') ORDER BY verified_at DESC, id LIMIT 8),
tr AS (SELECT 'applicable_principles' AS slot, id, content, verified_at FROM pr WHERE id NOT IN (FROM rej) UNION ALL SELECT 'preferences_and_boundaries', id, content, verified_at FROM bo WHERE id NOT IN (FROM rej)),
tp AS (SELECT slot, row_number() OVER (PARTITION BY slot ORDER BY verified_at DESC, id) AS pos, id, substr(content, 1, 200) AS content FROM tr),
cf AS (SELECT id, description FROM (SELECT * FROM trait_conflicts WHERE resolved = 0 ORDER BY id LIMIT 5) UNION SELECT id, description FROM trait_conflicts WHERE resolved = 0 AND trait_id IN (SELECT id FROM tr)),
pk AS (SELECT * FROM tp UNION ALL SELECT 'open_conflicts', 0, CAST(id AS VARCHAR), description FROM cf
UNION ALL SELECT * FROM (SELECT 'open_conflicts', 1, 'node:' || id, substr(content, 1, 150) FROM nodes WHERE status = 'active' AND type = 'Question' ORDER BY created_at DESC, id LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'relevant_episodes', 0, id, substr(content, 1, 200) FROM captures WHERE actor = 'owner' AND length(content) > 10 ORDER BY created_at DESC, id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'relevant_episodes', 0, session_id, substr(summary, 1, 200) FROM sessions WHERE summary <> '' ORDER BY started_at DESC, sessions.id LIMIT 3))"""


def _pack(t):
    return C.pack(t.traits, t.trait_conflicts, t.feedback_events, t.nodes, t.captures, t.sessions)


@query("cx04_context_pack", "CX3 CX4 TR8", "traits trait_conflicts feedback_events nodes captures sessions", f"{PACK} SELECT * FROM pk")
def cx04(t):
    return _pack(t)


@query("cx05_budget_trim", "CX5 WN11", "traits trait_conflicts feedback_events nodes captures sessions", f"""{PACK}, sz AS (SELECT slot, greatest(1, sum(length(content)) // 2) AS tok, greatest(1, length('{{"_trimmed": true, "_count": ' || count(*) || '}}') // 2) AS ph,
 CASE slot WHEN 'preferences_and_boundaries' THEN 1 WHEN 'applicable_principles' THEN 2 WHEN 'open_conflicts' THEN 3 ELSE 5 END AS prio FROM pk GROUP BY slot),
b AS (SELECT a.slot, a.tok, a.ph, (SELECT sum(tok) FROM sz) - coalesce((SELECT sum(tok - ph) FROM sz c WHERE c.prio > a.prio), 0) AS before FROM sz a)
SELECT slot, CAST(tok AS BIGINT) AS tokens, before > 1500 AS trimmed, CAST(CASE WHEN before > 1500 THEN ph ELSE tok END AS BIGINT) AS tokens_after FROM b""")
def cx05(t):
    return C.trim_plan(C.slot_tokens(_pack(t)), 1500)


@query("cx07_policy_rules", "CX7", "traits feedback_events trait_conflicts", """WITH ok AS (SELECT * FROM traits WHERE status = 'verified' AND approval = 'approved' AND id NOT IN (SELECT target_id FROM feedback_events WHERE feedback_type = 'reject' AND target_type = 'trait')
 AND id NOT IN (SELECT trait_id FROM trait_conflicts WHERE resolved = 0))
SELECT id, dimension, 'auto_' || lower(array_to_string(list_filter(string_split_regex(trim(regexp_replace(substr(content, 1, 60), '[^a-zA-Z가-힣0-9\\s]', '', 'g')), '\\s+'), lambda w: w <> '')[1:5], '_')) || '_' || substr(id, 1, 8) AS name,
 CASE dimension WHEN 'preference' THEN 'prefer' WHEN 'language' THEN 'prefer' WHEN 'emotion' THEN 'avoid' ELSE 'do' END AS rule_type FROM ok""")
def cx07(t):
    return C.compile_policy(t.traits, t.feedback_events, t.trait_conflicts)


# --- tasks -----------------------------------------------------------------

@query("ts01_ready_status", "TS1", "tasks task_deps", """SELECT t.id, count(b.id) AS n_blockers, CASE WHEN bool_and(coalesce(b.status, 'done') = 'done') THEN 'ready' ELSE 'backlog' END AS resolved
FROM tasks t LEFT JOIN task_deps d ON d.task_id = t.id LEFT JOIN tasks b ON b.id = d.blocked_by GROUP BY t.id""")
def ts01(t):
    return K.ready_status(t.tasks, t.task_deps)


@query("ts02_unblock_dependents", "TS2 MX6", "tasks task_deps", """WITH done AS (SELECT id FROM tasks WHERE status = 'in_progress'), aft AS (SELECT id, CASE WHEN id IN (FROM done) THEN 'done' ELSE status END AS status FROM tasks)
SELECT id, 'done' AS new_status FROM done UNION ALL SELECT a.id, 'ready' FROM aft a WHERE a.status = 'backlog' AND EXISTS (SELECT 1 FROM task_deps d WHERE d.task_id = a.id AND d.blocked_by IN (FROM done))
 AND NOT EXISTS (SELECT 1 FROM task_deps d JOIN aft b ON b.id = d.blocked_by WHERE d.task_id = a.id AND b.status <> 'done')""")
def ts02(t):
    return K.complete(t.tasks, t.task_deps, t.tasks.where("status = 'in_progress'").select("id"))


@query("ts03_cycle_check", "TS3", "tasks task_deps", """WITH RECURSIVE pro AS (SELECT t.id AS task_id, t.id + t.priority AS blocked_by FROM tasks t),
walk AS (SELECT task_id AS root, task_id AS id FROM pro UNION SELECT w.root, d.task_id FROM walk w JOIN task_deps d ON d.blocked_by = w.id)
SELECT p.task_id, p.blocked_by FROM pro p WHERE EXISTS (SELECT 1 FROM walk w WHERE w.root = p.task_id AND w.id = p.blocked_by)""")
def ts03(t):
    proposed = t.tasks.select(F.col("id").alias("task_id"), (F.col("id") + F.col("priority")).alias("blocked_by"))
    return K.cycle_edges(t.task_deps, proposed)


@query("ts04_open_tasks", "TS4 FLT1", "tasks task_deps", """SELECT t.id, title, project, status, priority, d.blocked_by FROM tasks t LEFT JOIN task_deps d ON d.task_id = t.id
WHERE status IN ('ready', 'in_progress') AND project = 'src3'""")
def ts04(t):
    return K.query_tasks(t.tasks, t.task_deps, limit=None, project="src3")


@query("ts05_next_lines", "TS5 SNK8", "tasks", "SELECT id, '- [P' || priority || '] ' || title || ' (' || project || ')' AS line FROM tasks WHERE status = 'ready' ORDER BY priority, created_at, id LIMIT 10")
def ts05(t):
    return K.next_lines(t.tasks)


# --- events ----------------------------------------------------------------

@query("st01_first_arrivals", "ST1", "session_events", "SELECT DISTINCT event_id, session_id, event_type, status FROM session_events")
def st01(t):
    return K.first_arrivals(t.session_events).select("event_id", "session_id", "event_type", "status")


@query("mx07_event_types", "MX7", "session_events", f"""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'signal' WHEN 'click' THEN 'decision' ELSE event_type END AS event_type FROM session_events)
SELECT event_id, event_type, event_type IN ({quoted(K.EVENT_TYPES)}) AS accepted, CASE WHEN event_type NOT IN ({quoted(K.EVENT_TYPES)}) THEN 'unknown event type, expected: {", ".join(K.EVENT_TYPES)}' END AS error FROM e""")
def mx07(t):
    seen = F.when(F.col("event_type") == "view", "signal").when(F.col("event_type") == "click", "decision").otherwise(F.col("event_type"))
    return K.checked_events(t.session_events.select("event_id", seen.alias("event_type")))


@query("cx03_project_decisions", "CX3", "nodes", """SELECT id, type, created_at FROM nodes WHERE status = 'active' AND type = 'Decision' AND (contains(lower(content), 'the') OR contains(lower(content), 'de')) ORDER BY created_at DESC, id LIMIT 5""")
def cx03_decisions(t):
    return C.project_decisions(t.nodes, ["The", "de"]).select("id", "type", "created_at")


@query("st02_poll_events", "ST2 FLT1", "session_events", """SELECT DISTINCT event_id, session_id, event_type, created_at FROM session_events WHERE status = 'ACTIVE' AND session_id <> 's8' AND event_type = 'click' AND target IN ('s8', 'all', '') AND created_at >= TIMESTAMP '2024-01-15' ORDER BY created_at DESC, event_id LIMIT 50""")
def st02(t):
    return K.poll(K.first_arrivals(t.session_events), "s8", since="2024-01-15 00:00:00", target="s8", event_type="click").select(
        "event_id", "session_id", "event_type", "created_at")


@query("st03_latest_event_state", "ST3", "session_events", "SELECT event_id, CASE WHEN bool_or(status = 'RESOLVED') THEN 'RESOLVED' ELSE 'ACTIVE' END AS status FROM session_events GROUP BY event_id")
def st03(t):
    return K.latest_state(t.session_events)


@query("mx06_completion_event_ids", "MX6", "tasks", "SELECT id, substr(sha256('s1:task_complete:' || id), 1, 16) AS event_id FROM tasks WHERE status = 'done'")
def mx06(t):
    done = t.tasks.where("status = 'done'")
    return done.select("id", K.completion_event_id(F.lit("s1"), F.col("id").cast("string")).alias("event_id"))


# --- traits ----------------------------------------------------------------

@query("tr01_unprocessed_captures", "TR1 JN7", "captures claims", "SELECT c.id, c.actor FROM captures c LEFT JOIN claims k ON k.capture_id = c.id WHERE k.id IS NULL")
def tr01(t):
    return R.unprocessed(t.captures, t.claims).select("id", "actor")


@query("tr02_claims_from_extraction", "TR2", "captures claims traits", """WITH ex AS (SELECT capture_id, text, CASE claim_type WHEN 'preference' THEN 'preference' WHEN 'decision' THEN 'decision_style' ELSE 'rhythm' END AS dimension, confidence FROM claims)
SELECT capture_id, trim(text) AS text, CASE dimension WHEN 'preference' THEN 'preference' WHEN 'decision_style' THEN 'decision' ELSE 'observation' END AS claim_type, confidence, 'provisional' AS status FROM ex WHERE trim(text) <> ''
UNION ALL SELECT id, '[no extractable claims]', 'skip', CAST(0 AS DOUBLE), 'skip' FROM captures WHERE id NOT IN (SELECT capture_id FROM ex)""")
def tr02(t):
    dim = F.when(F.col("claim_type") == "preference", "preference").when(F.col("claim_type") == "decision", "decision_style").otherwise("rhythm")
    return R.claims_from_extraction(t.captures, t.claims.select("capture_id", "text", dim.alias("dimension"), "confidence"))


@query("tr03_trait_sources", "TR3 FLT8", "nodes", """SELECT id, type, coalesce(quality_score, 0) AS quality, coalesce(maturity, 0) AS maturity FROM nodes WHERE status = 'active' AND type IN ('Insight', 'Decision', 'Identity', 'Principle')
 AND length(content) BETWEEN 50 AND 800 AND (contains(lower(content), 'the') OR contains(lower(content), 'und '))""")
def tr03(t):
    return R.trait_sources(t.nodes, ["Insight", "Decision", "Identity", "Principle"], ["the", "und "])


@query("tr04_evidence_boost", "TR4 FLT5 JN11 JN18", "traits trait_evidence claims captures", """WITH h AS (SELECT trait_id, count(*) AS c FROM trait_evidence GROUP BY 1),
s AS (SELECT t.id, 12 - coalesce(h.c, 0) AS needed, list_filter(string_split_regex(t.content, '\\s+'), lambda w: length(w) >= 3)[1:3] AS ws FROM traits t LEFT JOIN h ON h.trait_id = t.id WHERE t.status <> 'archived' AND coalesce(h.c, 0) < 12),
k AS (SELECT id, needed, unnest(ws) AS word, unnest(range(len(ws))) AS ord FROM s),
m AS (SELECT k.id AS trait_id, c.id AS claim_id, k.needed, k.ord, row_number() OVER (PARTITION BY k.id, lower(k.word) ORDER BY c.id) AS n FROM k JOIN claims c ON contains(lower(c.text), lower(k.word)) JOIN captures p ON p.id = c.capture_id
 WHERE c.status <> 'rejected' AND p.actor = 'owner' AND length(c.text) >= 20 AND NOT EXISTS (SELECT 1 FROM trait_evidence e WHERE e.trait_id = k.id AND e.claim_id = c.id)),
u AS (SELECT trait_id, claim_id, any_value(needed) AS needed, min(ord) AS ord FROM m WHERE n <= 12 GROUP BY 1, 2)
SELECT trait_id, claim_id, CAST(0.3 AS DOUBLE) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY trait_id ORDER BY ord, claim_id) AS pos FROM u) WHERE pos <= needed""")
def tr04(t):
    return R.evidence_boost(t.traits, t.trait_evidence, t.claims, t.captures, target=12)


@query("ag14_evidence_ratio", "AG14", "traits trait_evidence", "SELECT count(DISTINCT t.id) AS traits, round(CAST(count(e.id) AS DOUBLE) / count(DISTINCT t.id), 6) AS evidence_per_trait FROM traits t LEFT JOIN trait_evidence e ON e.trait_id = t.id WHERE t.status <> 'archived'")
def ag14(t):
    return R.evidence_ratio(t.traits, t.trait_evidence)


@query("tr05_dimension_coverage", "TR5", "traits", """SELECT d AS dimension, count(t.id) AS n, CASE WHEN d = 'unclassified' THEN CASE WHEN count(t.id) > 0 THEN 'few' ELSE 'enough' END WHEN count(t.id) >= 3 THEN 'enough' WHEN count(t.id) > 0 THEN 'few' ELSE 'none' END AS mark
FROM (SELECT unnest(['preference', 'emotion', 'decision_style', 'thinking_style', 'language', 'rhythm', 'metacognition', 'connection', 'unclassified']) AS d) LEFT JOIN traits t ON t.dimension = d AND t.status <> 'archived' GROUP BY d""")
def tr05(t):
    return R.coverage(t.traits)


@query("tr06_review_marks", "TR6", "traits feedback_events", """WITH d AS (SELECT target_id AS prefix, max(CASE feedback_type WHEN 'approve' THEN 'x' ELSE 'r' END) AS mark FROM feedback_events WHERE target_type = 'trait' AND feedback_type IN ('approve', 'reject') GROUP BY 1)
SELECT t.id, CASE max(mark) WHEN 'x' THEN 'verified' ELSE 'archived' END AS status, CASE max(mark) WHEN 'x' THEN 'approved' ELSE 'rejected' END AS approval FROM traits t JOIN d ON starts_with(t.id, d.prefix) WHERE t.status <> 'archived' GROUP BY t.id""")
def tr06(t):
    marks = t.feedback_events.where("target_type = 'trait' AND feedback_type IN ('approve', 'reject')").groupBy(
        F.col("target_id").alias("prefix")).agg(F.max(F.when(F.col("feedback_type") == "approve", "x").otherwise("r")).alias("mark"))
    return R.apply_review(t.traits, marks)


IDT = """idt AS (SELECT 'n' || id AS id, id AS node, CASE epistemic_status WHEN 'validated' THEN 'verified' WHEN 'outdated' THEN 'dormant' ELSE 'provisional' END AS status,
 CASE epistemic_status WHEN 'validated' THEN 'approved' WHEN 'outdated' THEN 'expired' WHEN 'flagged' THEN 'rejected' ELSE 'pending' END AS approval FROM nodes WHERE type = 'Identity' AND status = 'active')"""


@query("tr07_identity_traits", "TR7", "nodes", f"WITH {IDT} SELECT id, status, approval, 'unclassified' AS dimension FROM idt")
def tr07(t):
    return R.identity_traits(t.nodes).select("id", "status", "approval", "dimension")


@query("tr07_evidence_bridge", "TR7 JN19", "nodes edges", f"""WITH {IDT} SELECT e.id AS edge_id, i.id AS trait_id, e.source_id, coalesce(nullif(e.strength, 0), 1) AS strength, substr(n.content, 1, 500) AS claim_text
FROM edges e JOIN idt i ON i.node = e.target_id JOIN nodes n ON n.id = e.source_id WHERE e.status = 'active' AND e.relation IN ('generalizes_to', 'expressed_as', 'instantiated_as')""")
def tr07_bridge(t):
    return R.evidence_from_edges(t.nodes, t.edges, R.identity_traits(t.nodes))


@query("tr07_correction_conflicts", "TR7 JN19", "nodes edges", f"""WITH {IDT} SELECT e.id AS edge_id, i.id AS trait_id, 'legacy:node:' || e.source_id AS source_ref, coalesce(e.description, '') AS description
FROM edges e JOIN idt i ON i.node = e.target_id JOIN nodes n ON n.id = e.source_id AND n.type = 'Correction' WHERE e.status = 'active' AND e.relation = 'contradicts'""")
def tr07_conflicts(t):
    return R.conflicts_from_corrections(t.nodes, t.edges, R.identity_traits(t.nodes))


@query("jn04_missing_references", "JN4 JN7", "claims captures trait_evidence", """SELECT 'evidence' AS kind, id FROM trait_evidence WHERE claim_id NOT IN (SELECT id FROM claims WHERE status <> 'rejected')
UNION ALL SELECT 'claim', id FROM claims WHERE capture_id NOT IN (SELECT id FROM captures)""")
def jn04(t):
    ev = R.missing_references(t.trait_evidence, "claim_id", t.claims.where("status <> 'rejected'"))
    cl = R.missing_references(t.claims, "capture_id", t.captures)
    return ev.select(F.lit("evidence").alias("kind"), "id").unionAll(cl.select(F.lit("claim").alias("kind"), "id"))
