"""Learning, decay, pruning and promotion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.fixtures import AS_OF
from loomgraph.operators import graph as G
from loomgraph.operators import lifecycle as L
from loomgraph.plans.registry import query
from loomgraph.plans.retrieval_plans import REQUESTS, SCORED, TOP, _ranked
from loomgraph.plans.sqlparts import LIVE, NOW, ends, quoted

TOP5 = f"{SCORED}, res AS (SELECT qid, id, rank FROM final WHERE rank <= 5)"


def _age(col: str) -> str:
    return f"greatest(floor((epoch({NOW}) - epoch({col})) / 86400), 0)"


@query("lc01_sprt", "LC1 WN4 WN5", "nodes recall_log", """WITH last AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, id DESC) AS rn FROM recall_log r) WHERE rn <= 50),
walk AS (SELECT l.node_id, row_number() OVER w AS step, sum(CASE WHEN round(score, 4) > 0.5 THEN ln(CAST(0.7 AS DOUBLE) / 0.3) ELSE ln(CAST(0.3 AS DOUBLE) / 0.7) END) OVER w AS llr
 FROM last l JOIN nodes n ON n.id = l.node_id AND n.type = 'Signal' AND n.status = 'active' WINDOW w AS (PARTITION BY l.node_id ORDER BY l.ts, l.id)),
m AS (SELECT node_id, count(*) AS n_obs, min(CASE WHEN llr >= ln(0.8 / 0.05) THEN step END) AS up, min(CASE WHEN llr <= ln(0.2 / 0.95) THEN step END) AS down FROM walk GROUP BY node_id)
SELECT node_id AS id, CAST(n_obs AS INTEGER) AS n_obs, CASE WHEN n_obs < 5 THEN 'open' WHEN up IS NOT NULL AND (down IS NULL OR up < down) THEN 'promote' WHEN down IS NOT NULL THEN 'reject' ELSE 'open' END AS verdict FROM m""")
def lc01(t):
    return L.sprt(t.nodes, t.recall_log)


HEBB = f"""{TOP5}, pool AS (SELECT * FROM live WHERE coalesce(generation_method, '') NOT IN ({quoted(O.GRAPH_EXCLUDED_METHODS)})),
sd AS (SELECT r.qid, p.id, p.source_id IN (SELECT id FROM res x WHERE x.qid = r.qid) AS s, p.target_id IN (SELECT id FROM res x WHERE x.qid = r.qid) AS t FROM pool p, (SELECT DISTINCT qid FROM res) r),
gains AS (SELECT qid, id, CAST(0.015 AS DOUBLE) AS g FROM sd WHERE s AND t UNION ALL
 SELECT qid, id, CAST(0.005 AS DOUBLE) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id) AS rn FROM sd WHERE s <> t) WHERE rn <= 50),
tot AS (SELECT id, sum(g) AS g, count(*) AS h FROM gains GROUP BY id)"""


@query("lc03_hebbian_update", "LC3", "nodes edges", f"""WITH {HEBB}
SELECT e.id, round(least(CASE WHEN coalesce(strength, 0) = 0 THEN 1 ELSE strength END + t.g, 2.0), 6) AS strength, coalesce(frequency, 0) + t.h AS frequency FROM edges e JOIN tot t ON t.id = e.id""")
def lc03(t):
    return L.hebbian_update(t.nodes, t.edges, _ranked(t, 5), AS_OF).select("id", "strength", "frequency")


ENTRIES = f"""{HEBB}, asked AS (SELECT * FROM (VALUES {", ".join(f"({q}, '{text}')" for q, text in REQUESTS.items())}) v(qid, q)),
newest AS (SELECT g.id, list('{{"q":"' || a.q || '","t":"{AS_OF}"}}' ORDER BY g.qid) AS entries FROM gains g JOIN asked a ON a.qid = g.qid GROUP BY g.id),
logs AS (SELECT e.id, list_concat(CASE WHEN json_valid(e.description) AND e.description <> '' THEN list_transform(json_extract(e.description, '$[*]'), lambda x: CAST(x AS VARCHAR)) ELSE [] END, f.entries) AS a FROM edges e JOIN newest f ON f.id = e.id)"""


@query("lc03_context_log", "LC3", "nodes edges", f"WITH {ENTRIES} SELECT id, '[' || array_to_string(a[greatest(len(a) - 4, 1):], ',') || ']' AS description FROM logs")
def lc03_log(t):
    return _learnt(t)["edges"].select("id", "description")


def _learnt(t, k=5):
    ranked = _ranked(t, k).select("qid", "id", "rank", "score", "type", "layer")
    return L.learn(t.nodes, t.edges, L.score_history(t.recall_log, among=ranked), ranked, REQUESTS, AS_OF)


STEP = "CASE WHEN a[i] > 0.5 THEN ln(CAST(0.7 AS DOUBLE) / 0.3) ELSE ln(CAST(0.3 AS DOUBLE) / 0.7) END"


@query("wn05_score_history", "WN5 LC1", "nodes edges recall_log", f"""WITH {SCORED}, res AS (SELECT qid, id, rank, score FROM final WHERE rank <= 15),
last AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, id DESC) AS rn FROM recall_log r) WHERE rn <= 50),
hist AS (SELECT node_id AS id, list(round(score, 4) ORDER BY ts, id) AS old FROM last GROUP BY node_id),
mx AS (SELECT qid, max(score) AS m FROM res GROUP BY qid),
nw AS (SELECT r.id, list(round(CASE WHEN m > 0 THEN r.score / m ELSE 0 END, 4) ORDER BY r.qid) AS fresh FROM res r JOIN mx ON mx.qid = r.qid JOIN nodes n ON n.id = r.id AND n.type = 'Signal' GROUP BY r.id),
full_ AS (SELECT nw.id, list_concat(coalesce(old, []), fresh) AS a FROM nw LEFT JOIN hist ON hist.id = nw.id), kept AS (SELECT id, a[greatest(len(a) - 49, 1):] AS a FROM full_),
steps AS (SELECT id, i, sum({STEP}) OVER (PARTITION BY id ORDER BY i) AS llr FROM kept, unnest(range(1, len(a) + 1)) u(i)),
m AS (SELECT id, min(CASE WHEN llr >= ln(0.8 / 0.05) THEN i END) AS up, min(CASE WHEN llr <= ln(0.2 / 0.95) THEN i END) AS down FROM steps GROUP BY id)
SELECT kept.id, '[' || array_to_string(a, ',') || ']' AS score_history, len(a) >= 5 AND up IS NOT NULL AND (down IS NULL OR up < down) AS promote FROM kept JOIN m ON m.id = kept.id""")
def wn05(t):
    return _learnt(t, 15)["histories"]


@query("lc04_visit_update", "LC4", "nodes edges", f"""WITH {TOP5} SELECT n.id, coalesce(n.visit_count, 0) + h.c AS visit_count, coalesce(n.observation_count, 0) + h.c AS observation_count
FROM nodes n JOIN (SELECT id, count(*) AS c FROM res GROUP BY id) h ON h.id = n.id""")
def lc04(t):
    return L.visit_update(t.nodes, _ranked(t, 5), AS_OF).drop("last_accessed_at")


@query("lc06_edge_contribution", "LC6", "nodes edges", f"""WITH {TOP5}, hit AS (SELECT DISTINCT s.qid, e.id FROM edges e JOIN seeds s ON s.id IN (e.source_id, e.target_id)
 JOIN res r ON r.qid = s.qid AND ((s.id = e.source_id AND r.id = e.target_id) OR (s.id = e.target_id AND r.id = e.source_id)) WHERE e.status = 'active')
SELECT e.id, coalesce(e.frequency, 0) + h.c AS frequency FROM edges e JOIN (SELECT id, count(*) AS c FROM hit GROUP BY id) h ON h.id = e.id""")
def lc06(t):
    from loomgraph.plans.retrieval_plans import _seeds
    _, seeds = _seeds(t)
    return L.edge_contribution(t.edges, seeds, _ranked(t, 5))


@query("lc05_activation_rows", "LC5", "nodes edges", f"""WITH {TOP}, t AS (SELECT r.*, n.layer, CAST(round(r.score, 4) AS VARCHAR) AS s FROM res r JOIN nodes n ON n.id = r.id)
SELECT qid, 'recall' AS action_type, 'claude' AS actor, CAST(NULL AS BIGINT) AS target_id, '{{"query":"batch","result_count":' || count(*) || ',"top_ids":[' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 10) || ']}}' AS params,
 '{{"count":' || count(*) || ',"top_scores":[' || string_agg(s, ',' ORDER BY rank) FILTER (rank <= 5) || ']}}' AS result FROM t GROUP BY qid
UNION ALL SELECT qid, 'node_activated', 'system', id, '{{"context_query":"batch","activation_score":' || s || ',"activation_rank":' || rank || ',"channel":"hybrid","node_type":"' || type || '","node_layer":' || coalesce(CAST(layer AS VARCHAR), 'null') || '}}', NULL FROM t WHERE rank <= 10""")
def lc05(t):
    ranked = _ranked(t).select("qid", "id", "rank", "score", "type", "layer")
    return L.activation_rows(ranked, "batch", "s1", AS_OF).drop("session_id", "created_at")


@query("lc07_edge_decay", "LC7", "edges", f"""WITH b AS (SELECT id, coalesce(strength, 0) AS s, strength, {_age('coalesce(last_activated, created_at)')} AS d FROM edges WHERE status <> 'deleted'),
r AS (SELECT *, s * pow(CAST(0.999 AS DOUBLE), d) AS raw FROM b),
o AS (SELECT *, CASE WHEN d = 0 THEN 'unchanged' WHEN raw < 0.05 AND s <= 0.05 THEN 'at_floor' WHEN raw < 0.05 THEN 'floored' WHEN abs(raw - s) < 0.000000001 THEN 'unchanged' ELSE 'decayed' END AS outcome FROM r)
SELECT id, strength, CASE outcome WHEN 'decayed' THEN round(raw, 6) WHEN 'floored' THEN CAST(0.05 AS DOUBLE) ELSE strength END AS new_strength, outcome FROM o""")
def lc07(t):
    return L.decay_edges(t.edges, AS_OF)


PRUNE = """act AS (SELECT * FROM edges WHERE status = 'active'), d AS (SELECT id, count(*) AS deg FROM (SELECT source_id AS id FROM act UNION ALL SELECT target_id FROM act) GROUP BY id),
weak AS (SELECT * FROM act WHERE coalesce(strength, 0) + coalesce(frequency, 0) * CAST(0.1 AS DOUBLE) <= 0.05
 AND CASE description WHEN '[{"q": "alpha"}, {"q": "beta"}]' THEN 2 WHEN '[{"q": "alpha"}, {"q": "alpha"}]' THEN 1 ELSE 0 END < 2)"""


@query("lc08_edge_pruning", "LC8", "nodes edges", f"""WITH {PRUNE} SELECT w.id, CASE WHEN s.deg <= 1 OR t.deg <= 1 THEN 'guarded' WHEN n.tier = 0 OR coalesce(n.layer, 0) >= 2 THEN 'archive' ELSE 'delete' END AS decision
FROM weak w JOIN d s ON s.id = w.source_id JOIN d t ON t.id = w.target_id LEFT JOIN nodes n ON n.id = w.source_id""")
def lc08(t):
    return L.edge_pruning(t.nodes, t.edges)


@query("lc08_edge_pruning_applied", "LC8", "nodes edges", f"""WITH RECURSIVE {PRUNE}, todo AS (SELECT w.id, w.source_id, w.target_id, s.deg AS sd, t.deg AS td, n.tier = 0 OR coalesce(n.layer, 0) >= 2 AS old,
 row_number() OVER (ORDER BY w.id) AS pos FROM weak w JOIN d s ON s.id = w.source_id JOIN d t ON t.id = w.target_id LEFT JOIN nodes n ON n.id = w.source_id),
walk AS (SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS BIGINT) AS id, '' AS decision UNION ALL
 SELECT pos, CASE WHEN decision = 'delete' THEN list_concat(gone, [source_id, target_id]) ELSE gone END, id, decision FROM (
  SELECT t.pos, w.gone, t.id, t.source_id, t.target_id, CASE WHEN t.sd - len(list_filter(w.gone, lambda x: x = t.source_id)) <= 1 OR t.td - len(list_filter(w.gone, lambda x: x = t.target_id)) <= 1
   THEN 'guarded' WHEN coalesce(t.old, false) THEN 'archive' ELSE 'delete' END AS decision FROM walk w JOIN todo t ON t.pos = w.pos + 1))
SELECT id, decision FROM walk WHERE pos > 0""")
def lc08_applied(t):
    return L.edge_pruning_applied(t.nodes, t.edges)


HUBS10 = """hub10 AS (SELECT target_id AS id FROM edges e JOIN nodes n ON n.id = e.target_id AND n.status = 'active' GROUP BY target_id ORDER BY count(*) DESC, target_id LIMIT 10)"""


def _hub10(t):
    snap = G.in_degree(t.nodes, t.edges, 10).select(F.col("id").alias("node_id"), "ihs_score", F.lit(AS_OF).alias("snapshot_date"))
    return L.top_hubs(snap)


@query("lc09_prune_candidates", "LC9 FLT9 FLT16 JN8 MX8", "nodes edges", f"""WITH {HUBS10}, {ends('edges')}
SELECT n.id, coalesce(d.c, 0) AS edge_count, coalesce(n.quality_score, 0) AS quality, n.id NOT IN (FROM hub10) AS allowed
FROM nodes n LEFT JOIN (SELECT nid, count(*) AS c FROM ends GROUP BY nid) d ON d.nid = n.id
WHERE n.status = 'active' AND coalesce(n.quality_score, 0) < 0.3 AND coalesce(n.observation_count, 0) < 2 AND n.layer IN (0, 1)
 AND (n.updated_at IS NULL OR n.updated_at < {NOW} - INTERVAL 90 DAY) AND coalesce(d.c, 0) < 3 ORDER BY quality, n.id LIMIT 100""")
def lc09(t):
    return L.node_prune_candidates(t.nodes, t.edges, AS_OF, _hub10(t))


@query("flt16_permissions", "FLT16", "nodes edges", f"""WITH {HUBS10}, a(actor, op) AS (VALUES ('system:pruning', 'write'), ('claude', 'delete'), ('enrichment:E7', 'modify_content'), ('owner', 'write'), ('claude', 'modify_metadata'), ('guest', 'read'))
SELECT n.id, a.actor, a.op AS operation, CASE WHEN a.op IN ('write', 'delete') AND n.id IN (FROM hub10) THEN FALSE ELSE
 CASE a.actor || ' ' || a.op WHEN 'system:pruning write' THEN coalesce(layer, 0) <= 1 WHEN 'claude delete' THEN coalesce(layer, 0) <= 1
 WHEN 'enrichment:E7 modify_content' THEN coalesce(layer, 0) <= 1 ELSE TRUE END END AS allowed FROM nodes n, a""")
def flt16(t):
    hub = F.broadcast(_hub10(t).withColumn("hub", F.lit(True)))
    rows = t.nodes.select("id", "layer").join(hub, "id", "left")
    asked = [("system:pruning", "write"), ("claude", "delete"), ("enrichment:E7", "modify_content"), ("owner", "write"),
             ("claude", "modify_metadata"), ("guest", "read")]
    each = F.array(*[F.struct(F.lit(a).alias("actor"), F.lit(o).alias("operation"),
                              L.permitted(F.col("layer"), o, a, F.col("hub")).alias("allowed")) for a, o in asked])
    return rows.select("id", F.explode(each).alias("x")).select("id", "x.actor", "x.operation", "x.allowed")


@query("lc10_expired_candidates", "LC10", "nodes", f"SELECT id FROM nodes WHERE status = 'pruning_candidate' AND updated_at < {NOW} - INTERVAL 30 DAY")
def lc10(t):
    return L.expired_candidates(t.nodes, AS_OF)


@query("lc11_dead_edges", "LC11", "edges", f"SELECT id FROM edges WHERE coalesce(last_activated, created_at) < {NOW} - INTERVAL 180 DAY AND frequency = 0 AND strength < 0.2")
def lc11(t):
    return L.dead_edges(t.edges, AS_OF)


def _growth(q="quality_score"):
    return (f"greatest(0.0, least(1.0, coalesce({q}, 0.5) * 0.3 + least(1.0, CAST(ec AS DOUBLE) / 10) * 0.2 + least(1.0, CAST(coalesce(visit_count, 0) AS DOUBLE) / 10) * 0.2"
            f" + least(1.0, CAST(np AS DOUBLE) / 3) * 0.2 + coalesce(greatest(0.0, 1 - {_age('created_at')} / 90), 0.5) * 0.1 - CASE WHEN co THEN 0.2 ELSE 0 END))")


@query("lc13_batch_growth", "LC12 LC13 JN3", "nodes edges", f"""WITH x AS (SELECT source_id AS nid, target_id AS nbr, relation FROM edges WHERE status = 'active' UNION ALL SELECT target_id, source_id, relation FROM edges WHERE status = 'active'),
g AS (SELECT nid, count(*) AS ec, count(DISTINCT nullif(m.project, '')) AS np, bool_or(relation = 'contradicts') AS co FROM x LEFT JOIN nodes m ON m.id = x.nbr AND m.status = 'active' GROUP BY nid),
r AS (SELECT n.*, coalesce(g.ec, 0) AS ec, coalesce(g.np, 0) AS np, coalesce(g.co, FALSE) AS co FROM nodes n LEFT JOIN g ON g.nid = n.id WHERE n.status = 'active')
SELECT id, round({_growth()}, 6) AS maturity FROM r""")
def lc13(t):
    return L.batch_growth(t.nodes, t.edges, AS_OF)


@query("lc14_becoming", "LC14 FLT7 TK2", "nodes edges", f"""WITH {LIVE}, {ends('live')}, g AS (SELECT nid, count(*) AS ec, count(DISTINCT nullif(m.project, '')) AS np, bool_or(relation = 'contradicts') AS co
 FROM ends x LEFT JOIN nodes m ON m.id = x.nbr AND m.status = 'active' GROUP BY nid),
r AS (SELECT n.*, coalesce(g.ec, 0) AS ec, coalesce(g.np, 0) AS np, coalesce(g.co, FALSE) AS co FROM nodes n LEFT JOIN g ON g.nid = n.id WHERE n.status = 'active'
 AND n.type IN ('Observation', 'Signal', 'Pattern', 'Insight') AND list_contains(domains, 'en'))
SELECT id, type, layer, ec AS edge_count, visit_count, round(least(1.0, CAST(np AS DOUBLE) / 3), 6) AS diversity, round({_growth()}, 6) AS growth_score,
 CASE type WHEN 'Observation' THEN 'Signal' WHEN 'Signal' THEN 'Pattern,Insight' WHEN 'Pattern' THEN 'Principle,Framework' ELSE 'Principle' END AS can_promote_to FROM r""")
def lc14(t):
    return L.becoming(t.nodes, t.edges, AS_OF, domain="en", top_k=None)


SWR = """sx AS (SELECT source_id AS nid, target_id AS nbr FROM edges WHERE status = 'active' UNION ALL SELECT target_id, source_id FROM edges WHERE status = 'active' AND source_id <> target_id),
sg AS (SELECT nid, count(*) AS ec, count(DISTINCT nullif(m.project, '')) AS np FROM sx LEFT JOIN nodes m ON m.id = sx.nbr GROUP BY nid),
sl AS (SELECT node_id, count(*) FILTER (contains(sources, '"vector"')) AS v, count(*) FILTER (contains(sources, '"fts5"')) AS f FROM recall_log WHERE sources <> '[]' GROUP BY node_id),
swr AS (SELECT n.id, 0.6 * CASE WHEN coalesce(v + f, 0) > 0 THEN CAST(v AS DOUBLE) / (v + f) ELSE 0.5 END + 0.4 * CASE WHEN coalesce(ec, 0) > 0 THEN CAST(np AS DOUBLE) / ec ELSE 0 END AS r
 FROM nodes n LEFT JOIN sg ON sg.nid = n.id LEFT JOIN sl ON sl.node_id = n.id)"""


@query("lc16_swr_readiness", "LC16", "nodes edges recall_log", f"WITH {SWR} SELECT id, round(r, 6) AS readiness, r > 0.25 AS swr_ok FROM swr")
def lc16(t):
    return L.swr_readiness(t.nodes, t.edges, t.recall_log)


PROMOTABLE = f"""{SWR}, pg AS (SELECT nid, bool_or(relation = 'contradicts') AS co FROM (SELECT source_id AS nid, relation FROM edges WHERE status = 'active' UNION ALL SELECT target_id, relation FROM edges WHERE status = 'active') GROUP BY nid),
pr AS (SELECT n.*, coalesce(sg.ec, 0) AS ec, coalesce(sg.np, 0) AS np, coalesce(pg.co, FALSE) AS co FROM nodes n LEFT JOIN sg ON sg.nid = n.id LEFT JOIN pg ON pg.nid = n.id
 WHERE n.status = 'active' AND n.type IN ('Observation', 'Signal', 'Pattern', 'Insight') AND coalesce(n.visit_count, 0) >= 3 AND n.epistemic_status <> 'validated'),
cand AS (SELECT *, {_growth('coalesce(quality_score, 0)')} AS growth FROM pr WHERE ec >= CASE WHEN visit_count >= 10 THEN 2 ELSE 3 END AND (ec >= 5 OR np >= 1))"""


@query("lc15_promotion_candidates", "LC15 LC17", "nodes edges recall_log", f"""WITH {PROMOTABLE}
SELECT c.id, type, CASE type WHEN 'Observation' THEN 'Signal' WHEN 'Signal' THEN 'Pattern' ELSE 'Principle' END AS target, visit_count, round(growth, 6) AS growth_score, ec AS edge_count, np AS n_projects, s.r > 0.25 AS swr_ok, round(s.r, 6) AS readiness
FROM cand c JOIN swr s ON s.id = c.id WHERE growth >= 0.5""")
def lc15(t):
    return L.promotion_candidates(t.nodes, t.edges, t.recall_log, AS_OF)


@query("lc18_mdl_gate", "LC18", "", """WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.label, avg(list_cosine_similarity(a.v, b.v)) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label)
SELECT CAST(u.label AS BIGINT) AS group_id, count(*) AS members, round(any_value(p.s), 6) AS avg_similarity, coalesce(round(any_value(p.s), 6) > 0.75, TRUE) AS passed FROM u LEFT JOIN p ON p.label = u.label GROUP BY u.label""")
def lc18(t):
    groups = t.base("embeddings").selectExpr("vec_id AS id", "CAST(label AS BIGINT) AS group_id")
    return L.mdl_gate(t.embeddings, groups)


@query("lc19_promotion_state", "LC19", "nodes edges recall_log", f"""WITH {PROMOTABLE}, ch AS (SELECT *, CASE type WHEN 'Observation' THEN 'Signal' WHEN 'Signal' THEN 'Pattern' ELSE 'Principle' END AS target FROM cand WHERE growth >= 0.5)
SELECT id, type AS old_type, target AS new_type, CAST(CASE target WHEN 'Signal' THEN 1 WHEN 'Pattern' THEN 2 ELSE 3 END AS INTEGER) AS new_layer,
 'knowledge_core' AS node_role, 'validated' AS epistemic_status FROM ch""")
def lc19(t):
    chosen = L.promotion_candidates(t.nodes, t.edges, t.recall_log, AS_OF)
    return L.promote(t.nodes, chosen, AS_OF).drop("history")


@query("lc19_realized_edges", "LC19", "nodes edges recall_log", f"""WITH {PROMOTABLE}, ch AS (SELECT * FROM cand WHERE growth >= 0.5)
SELECT e.source_id, e.target_id, 'realized_as' AS relation, CAST(1.0 AS DOUBLE) AS strength FROM edges e JOIN ch ON ch.id = e.target_id WHERE e.status = 'active' AND e.relation = 'supports'""")
def lc19_edges(t):
    chosen = L.promotion_candidates(t.nodes, t.edges, t.recall_log, AS_OF)
    related = G.active(t.edges).where("relation = 'supports'").select("target_id", F.col("source_id").alias("id"))
    return L.realized_edges(chosen, related)


@query("lc20_tiers", "LC20", "nodes", """SELECT id, tier, CAST(CASE WHEN layer = 2 AND quality_score >= 0.8 THEN 1 WHEN layer >= 3 THEN 0 WHEN tier IN (0, 1) THEN tier ELSE 2 END AS INTEGER) AS new_tier FROM nodes WHERE status = 'active'""")
def lc20(t):
    return L.assign_tiers(t.nodes)


@query("lc21_flags", "LC21", "nodes feedback_events", """WITH f AS (SELECT DISTINCT CAST(substr(target_id, 2) AS BIGINT) AS id FROM feedback_events WHERE target_type = 'node' AND feedback_type = 'flag')
SELECT n.id, round(greatest(0.1, coalesce(nullif(confidence, 0), 0.5) - 0.2), 6) AS confidence, 'flagged' AS epistemic_status FROM nodes n JOIN f ON f.id = n.id WHERE n.status = 'active'""")
def lc21(t):
    f = t.feedback_events.where("target_type = 'node' AND feedback_type = 'flag'").select(
        F.substring("target_id", 2, 20).cast("bigint").alias("id"), F.lit("inaccurate").alias("flag")).distinct()
    return L.flag_nodes(t.nodes, f)


FLAGS = """f AS (SELECT DISTINCT CAST(substr(target_id, 2) AS BIGINT) AS id, CASE CAST(substr(target_id, 2) AS BIGINT) % 3 WHEN 0 THEN 'inaccurate' WHEN 1 THEN 'outdated' ELSE 'irrelevant' END AS flag
 FROM feedback_events WHERE target_type = 'node')"""


def _flags(t):
    node = F.substring("target_id", 2, 20).cast("bigint")
    kind = F.when(F.col("id") % 3 == 0, "inaccurate").when(F.col("id") % 3 == 1, "outdated").otherwise("irrelevant")
    return t.feedback_events.where("target_type = 'node'").select(node.alias("id")).distinct().withColumn("flag", kind)


@query("lc21_flag_kinds", "LC21", "nodes feedback_events", f"""WITH {FLAGS}
SELECT n.id, round(greatest(0.1, coalesce(nullif(confidence, 0), 0.5) - CASE flag WHEN 'inaccurate' THEN 0.2 WHEN 'outdated' THEN 0.15 ELSE 0.1 END), 6) AS confidence,
 CASE flag WHEN 'inaccurate' THEN 'flagged' ELSE flag END AS epistemic_status FROM nodes n JOIN f ON f.id = n.id WHERE n.status = 'active'""")
def lc21_kinds(t):
    return L.flag_nodes(t.nodes, _flags(t))


@query("lc21_flag_corrections", "LC21", "nodes feedback_events", f"""WITH {FLAGS}
SELECT n.id AS contradicts_id, '[Correction] Node #' || n.id || ' flagged as ' || flag || ': checked' AS content, n.project, 'Correction' AS type, CAST(0.8 AS DOUBLE) AS confidence,
 CAST(0.9 AS DOUBLE) AS edge_strength, 'node' AS target_type, flag AS feedback_type FROM nodes n JOIN f ON f.id = n.id WHERE n.status = 'active'""")
def lc21_corrections(t):
    node, feedback = L.flag_corrections(t.nodes, _flags(t).withColumn("reason", F.lit("checked")))
    told = feedback.select(F.col("target_id").alias("contradicts_id"), "target_type", "feedback_type")
    return node.select("contradicts_id", "content", "project", "type", "confidence", "edge_strength").join(told, "contradicts_id")


@query("lc22_semantic_drift", "LC22", "", """SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) < 0.5 AS drifted
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def lc22(t):
    return L.semantic_drift(t.embeddings, t.embeddings.selectExpr("id - 1 AS id", "embedding"))


MEDIANS = """WITH s AS (SELECT type, length(summary) AS len, row_number() OVER (PARTITION BY type ORDER BY coalesce(updated_at, created_at) DESC, id DESC) AS k FROM nodes WHERE status = 'active' AND coalesce(summary, '') <> '')
SELECT type, count(*) AS sample_size, median(CAST(len AS DOUBLE)) AS median_len FROM s WHERE k <= 100 GROUP BY type HAVING count(*) >= 10"""


@query("lc23_summary_medians", "AG10 WN9", "nodes", MEDIANS)
def lc23_medians(t):
    return L.summary_medians(t.nodes)


@query("lc23_summary_anomalies", "LC23", "nodes", f"""SELECT n.id, n.type, length(n.summary) AS len, m.median_len FROM nodes n JOIN ({MEDIANS}) m ON m.type = n.type
WHERE n.summary <> '' AND length(n.summary) > m.median_len * {O.SUMMARY_LENGTH_MULTIPLIER}""")
def lc23(t):
    return L.summary_anomalies(t.nodes)


@query("mx10_status_counters", "MX10 AG3", "nodes", """SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'pruning_candidate') AS pruning_candidate, count(*) FILTER (status = 'archived') AS archived FROM nodes""")
def mx10(t):
    return t.nodes.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("active", "pruning_candidate", "archived")])
