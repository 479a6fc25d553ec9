"""Enrichment selection and answer handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.operators import enrichment as N
from loomgraph.operators import mining as M
from loomgraph.operators import tables as B
from loomgraph.plans.registry import query
from loomgraph.plans.sqlparts import quoted


@query("lc26_pending_work", "LC26 LT1", "nodes", """WITH a AS (SELECT * FROM nodes WHERE status = 'active')
SELECT 'new' AS phase, id FROM a WHERE enriched_at IS NULL UNION ALL SELECT 'retry', id FROM a WHERE enrichment_status = 'failed'
UNION ALL SELECT 'embedding_text', id FROM a WHERE summary IS NOT NULL AND len(key_concepts) > 0 UNION ALL SELECT 'layer_check', id FROM a WHERE layer IS NOT NULL UNION ALL SELECT 'secondary_types', id FROM a""")
def lc26(t):
    return N.pending(t.nodes)


@query("lc25_apply_answers", "LC25 LT1 LT2 LT3", "nodes", """SELECT id, substr(content, 1, 100) AS summary, array_to_string(string_split(content, ' ')[1:5], ',') AS key_concepts,
 array_to_string(list_concat(list_filter([trim(split_part(tags, ',', 1)), trim(split_part(tags, ',', 2))], lambda x: x <> ''), ['new']), ', ') AS tags,
 array_to_string(list_filter(['developer', 'designer', 'writer', 'researcher'], lambda x: list_contains(facets, x) OR (x = 'designer' AND regexp_matches(lower(content), '(?i)포트폴리오|디자인|UI|UX|레이아웃|타이포')) OR (x = 'developer' AND regexp_matches(lower(content || ' ' || source), '(?i)\\.claude/skills/|claude.*code|CLI|터미널|bash|python'))), ',') AS facets,
 CASE WHEN type = 'Tool' THEN 'art' ELSE '' END AS domains, round(least(1.0, greatest(0.0, coalesce(confidence * 1.5, 0.5))), 6) AS quality_score, CASE WHEN confidence > 0.8 AND promotion_candidate = 1 THEN 3 ELSE layer END AS layer FROM nodes""")
def lc25(t):
    n = t.nodes
    answers = n.select("id", F.col("content").alias("summary"), F.split("content", " ").alias("concepts"), F.array(F.lit("new")).alias("tags"), "facets",
                       F.when(F.col("type") == "Tool", F.array(F.lit("art"), F.lit("sport"))).otherwise(F.array(F.lit("sport"))).alias("domains"),
                       (F.col("confidence") * 1.5).alias("score"), F.lit(3).alias("layer"), F.col("confidence").alias("layer_confidence"),
                       (F.col("promotion_candidate") == 1).alias("changed"))
    return N.apply_answers(n, answers)


@query("lt03_secondary_types", "LT3", "nodes", f"""SELECT id, array_to_string(list_filter(['Decision', 'Insight', 'Pattern'], lambda x: x <> type)[1:2], ',') AS secondary FROM nodes""")
def lt03(t):
    answered = F.array(*[F.lit(x) for x in ("Decision", "Widget", "Insight", "Pattern")])
    return t.nodes.select("id", F.array_join(N.secondary_types(answered, F.col("type")), ",").alias("secondary"))


@query("lt05_refine_relations", "LT5", "edges", """SELECT id, relation AS old_relation, 'led_to' AS new_relation FROM edges WHERE status = 'active' AND relation IN ('connects_with', 'supports') AND strength > 0.5 AND frequency <> 3""")
def lt05(t):
    answers = t.edges.select("id", F.when(F.col("frequency") == 3, "made_up").otherwise("led_to").alias("relation"), (F.col("strength") > 0.5).alias("changed"))
    return N.refine_relations(t.edges, answers)


@query("lt06_edge_directions", "LT6 LT7", "nodes edges", """SELECT e.id, CASE WHEN e.direction IN ('upward', 'downward', 'horizontal', 'cross-layer') THEN e.direction WHEN s.layer < t.layer THEN 'upward' WHEN s.layer > t.layer THEN 'downward' ELSE 'horizontal' END AS direction,
 round(least(1.0, greatest(0.0, e.strength)), 6) AS strength, round(least(1.0, greatest(0.0, e.strength)), 6) AS base_strength FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.status = 'active'""")
def lt06(t):
    return N.direct_edges(t.nodes, t.edges)


@query("lt12_pair_edges", "LT12 LT13 LT15", "edges", """SELECT source_id, target_id, 'contradicts' AS relation, strength FROM edges WHERE strength >= 0.6 UNION ALL SELECT source_id, target_id, 'differs_in', CAST(0.7 AS DOUBLE) FROM edges UNION ALL SELECT source_id, target_id, 'assembles', CAST(0.8 AS DOUBLE) FROM edges""")
def lt12(t):
    pairs = t.edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("strength").alias("confidence"))
    return N.pair_edges(pairs, "contradicts").unionAll(N.pair_edges(pairs, "differs_in")).unionAll(N.pair_edges(pairs, "assembles"))


@query("lt16_domain_gaps", "LT16", "nodes", f"""WITH c AS (SELECT unnest(domains) AS domain, type FROM nodes WHERE status = 'active'), d AS (SELECT domain, count(*) AS nodes, list(DISTINCT type) AS have FROM c GROUP BY domain HAVING count(*) >= 3)
SELECT domain, nodes, array_to_string(list_filter(list_sort([{quoted(O.ACTIVE_TYPES)}]), lambda x: NOT list_contains(have, x)), ',') AS missing_types FROM d""")
def lt16(t):
    return N.domain_gaps(M.domain_type_counts(t.nodes))


@query("lt18_hint_batches", "LT18 WN12", "nodes", "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 20 AS batch FROM nodes WHERE status = 'active' AND retrieval_hints IS NULL")
def lt18(t):
    return N.hint_batches(t.nodes)


@query("lt19_edge_guard", "LT19 LT4", "nodes edges", """WITH p AS (SELECT id, target_id AS source_id, source_id + frequency * 400 AS target_id, CASE WHEN relation = 'realizes' THEN 'connects_with' WHEN relation = 'influences' THEN 'influences' WHEN relation = 'realized_as' THEN 'connects_with' ELSE relation END AS relation FROM edges),
q AS (SELECT id, source_id, target_id, relation FROM p) SELECT * FROM q WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)
 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = q.source_id AND e.target_id = q.target_id AND e.relation = q.relation)""")
def lt19(t):
    rel = F.when(F.col("relation") == "realized_as", "not_a_relation").otherwise(F.col("relation"))
    proposed = t.edges.select("id", F.col("target_id").alias("source_id"), (F.col("source_id") + F.col("frequency") * 400).alias("target_id"), rel.alias("relation"))
    return B.guard_edges(proposed, t.nodes, t.edges).select("id", "source_id", "target_id", "relation")
