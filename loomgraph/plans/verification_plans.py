"""The check runner over all check modules, and the schema checks on their own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.fixtures import AS_OF
from loomgraph.operators import quality as Q
from loomgraph.operators import verification as V
from loomgraph.plans.quality_plans import _run
from loomgraph.plans.registry import PLANS, query
from loomgraph.plans.sqlparts import quoted
from loomgraph.session import shared_folder

RULED = sorted({x for s, ts in O.RELATION_RULES.items() for x in (s, *ts)})
PROMOTED = sorted({x for s, ts in O.VALID_PROMOTIONS.items() for x in (s, *ts)})
RETIRED = quoted(V.RETIRED_TYPES)
_NAMES = "(SELECT unnest([{}]) AS name)".format
SCHEMA = f"""st AS (SELECT DISTINCT type AS name FROM nodes), sr AS (SELECT DISTINCT relation AS name FROM edges),
odd AS (
 SELECT 'promote_layer_in_schema' AS c, 'FAIL' AS bad, name FROM {_NAMES(quoted([t for t in O.PROMOTE_LAYER if t != 'Unclassified']))} WHERE name NOT IN (FROM st) AND name NOT IN ({RETIRED})
 UNION ALL SELECT 'schema_in_promote_layer', 'WARN', name FROM st WHERE name NOT IN ({quoted(O.PROMOTE_LAYER)}) AND name NOT IN ('Unclassified', {RETIRED})
 UNION ALL SELECT 'all_relations_match_schema', 'FAIL', name FROM {_NAMES(quoted(O.KNOWN_RELATIONS))} WHERE name NOT IN (FROM sr)
 UNION ALL SELECT 'all_relations_match_schema', 'FAIL', name FROM sr WHERE name NOT IN ({quoted(O.KNOWN_RELATIONS)})
 UNION ALL SELECT 'relation_rules_types_valid', 'FAIL', name FROM {_NAMES(quoted(RULED))} WHERE name NOT IN ({quoted(O.PROMOTE_LAYER)}, {RETIRED})
 UNION ALL SELECT 'valid_promotions_types_valid', 'FAIL', name FROM {_NAMES(quoted(PROMOTED))} WHERE name NOT IN ({quoted(O.PROMOTE_LAYER)}, {RETIRED})),
five AS (SELECT unnest(['promote_layer_in_schema', 'schema_in_promote_layer', 'all_relations_match_schema', 'relation_rules_types_valid', 'valid_promotions_types_valid']) AS c),
counts AS (SELECT 'type_defs_count' AS c, {len(O.ACTIVE_TYPES)} AS s, (SELECT count(*) FROM st) AS d UNION ALL SELECT 'relation_defs_count', {len(set(O.SCHEMA_RELATIONS))}, (SELECT count(*) FROM sr)),
schema_rows AS (SELECT f.c AS name, 'schema' AS category, CAST(count(o.name) AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS threshold, CASE WHEN count(o.name) = 0 THEN 'PASS' ELSE max(o.bad) END AS status,
  CASE WHEN count(o.name) = 0 THEN '[]' ELSE '["' || string_agg(o.name, '","' ORDER BY o.name) || '"]' END AS details FROM five f LEFT JOIN odd o ON o.c = f.c GROUP BY f.c
 UNION ALL SELECT c, 'schema', CAST(abs(s - d) AS DOUBLE), NULL, CASE WHEN s = d THEN 'PASS' ELSE 'WARN' END, '{{"stored":' || s || ',"declared":' || d || '}}' FROM counts)"""


def _schema(t):
    """The names in use are the declared ones here; the catalog of the library is what is stored."""
    stored = lambda names: t.spark.createDataFrame([(n, "active") for n in sorted(set(names))], "name string, status string")
    return V.schema_checks(t.nodes.select(F.col("type").alias("name")).distinct(), t.edges.select(F.col("relation").alias("name")).distinct(), stored(O.ACTIVE_TYPES), stored(O.SCHEMA_RELATIONS))


@query("qc05_schema_checks", "QC5", "nodes edges", f"WITH {SCHEMA} SELECT * FROM schema_rows")
def qc05_checks(t):
    return _schema(t)


PARTS = ["qc01_data_integrity", "qc02_enrichment_coverage", "qc03_graph_health", "qc06_promotion_checks", "qc08_search_quality"]
ROWS = " UNION ALL ".join(f"SELECT name AS check_name, category, score, threshold, status, '{{}}' AS details FROM ({PLANS[p].sql})" for p in PARTS)


@query("qc09_check_run", "QC9 MX9", "nodes edges", f"WITH {SCHEMA} {ROWS} UNION ALL SELECT * FROM schema_rows UNION ALL SELECT 'broken', 'error', NULL, NULL, 'FAIL', '{{\"error\": \"no such table\"}}'")
def qc09(t):
    def broken():
        raise ValueError("no such table")

    from loomgraph.operators import evaluation as E

    modules = {"data": lambda: Q.data_integrity(t.nodes, t.edges), "enrichment": lambda: Q.enrichment_coverage(t.nodes), "graph": lambda: Q.graph_health(t.nodes, t.edges),
               "promotion": lambda: Q.promotion_checks(t.nodes), "schema": lambda: _schema(t), "search": lambda: E.quality_checks(_run(t), t.goldset), "broken": broken}
    path = f"{shared_folder(t.spark)}/verification-{uuid.uuid4().hex}"
    V.run_checks(t.spark, {"data": modules["data"]}, "earlier", AS_OF, path)  # another run in the same log
    return V.run_checks(t.spark, modules, "r1", AS_OF, path).drop("run_id", "created_at")
