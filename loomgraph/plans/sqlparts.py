"""Pieces of check SQL shared by several plans: constant tables and common subqueries."""

from __future__ import annotations

from loomgraph import ontology as O
from loomgraph.fixtures import AS_OF


def values(name: str, cols: str, rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else (f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v))

    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


CLASSES = values("classes", "rel, cls, rnk", [(r, c, O.EDGE_CLASS_RANK[c]) for r, c in O.EDGE_CLASS.items()])
FAMILIES = values("families", "rel, w", [(r, O.RELATION_FAMILY_WEIGHT[f]) for r, f in O.RELATION_FAMILY.items()])
LAYERS = values("layers", "type, layer", list(O.PROMOTE_LAYER.items()))
RULES = values("rules", "st, tt, rel", [(s, t, r) for s, row in O.RELATION_RULES.items() for t, r in row.items()])
BACK = values("backs", "rel, rev", list(O.REVERSE_RELATION.items()))
CANON = values("canon", "rel, stored", list(O.RELATION_STORAGE_CANONICAL.items()))
NOW = f"TIMESTAMP '{AS_OF}'"

# live edges: active with two active ends
LIVE = """live AS (SELECT e.* FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id
 WHERE e.status = 'active' AND s.status = 'active' AND t.status = 'active')"""


def ends(edge_table: str, name: str = "ends") -> str:
    return f"""{name} AS (SELECT id AS edge_id, source_id AS nid, target_id AS nbr, TRUE AS outw, relation, strength FROM {edge_table}
 UNION ALL SELECT id, target_id, source_id, FALSE, relation, strength FROM {edge_table} WHERE source_id <> target_id)"""


def infer(s: str, t: str) -> str:
    """Relation inference between node aliases; needs the rules and backs constant tables."""
    cross = f"(coalesce({s}.project, '') <> '' AND coalesce({t}.project, '') <> '' AND {s}.project <> {t}.project)"
    same = f"(coalesce({s}.project, '') <> '' AND {s}.project = {t}.project)"
    return f"""coalesce((SELECT rel FROM rules WHERE st = {s}.type AND tt = {t}.type),
 (SELECT coalesce(b.rev, r.rel) FROM rules r LEFT JOIN backs b ON b.rel = r.rel WHERE r.st = {t}.type AND r.tt = {s}.type),
 CASE WHEN {s}.layer < {t}.layer THEN 'generalizes_to' WHEN {s}.layer > {t}.layer THEN 'expressed_as'
  WHEN {s}.layer = {t}.layer AND {s}.type = {t}.type THEN CASE WHEN {cross} THEN 'mirrors' ELSE 'supports' END
  WHEN {s}.layer = {t}.layer AND {cross} THEN 'correlated_with'
  WHEN {s}.layer = {t}.layer AND {same} THEN 'contains' ELSE 'connects_with' END)"""
