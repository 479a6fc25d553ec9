"""Work selection for enrichment and the deterministic handling of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.operators import graph as G
from loomgraph.operators.scale import numbered

# Facet patterns and project domains.
FACET_RULES = [
    (r"\.claude/skills/|claude.*code|CLI|터미널|bash|python", "developer"),
    (r"미학|들뢰즈|철학|존재론|현상학|인식론", "philosopher"),
    (r"포트폴리오|디자인|UI|UX|레이아웃|타이포", "designer"),
    (r"에세이|글쓰기|서사|내러티브|문체", "writer"),
    (r"시스템.*설계|아키텍처|거버넌스|오케스트레이션", "system-architect"),
    (r"연구|리서치|분석|조사|논문", "researcher"),
]
PROJECT_DOMAINS = ["orchestration", "portfolio", "tech-review", "monet-lab", "daily-memo"]
DIRECTIONS = ["upward", "downward", "horizontal", "cross-layer"]
GENERIC_RELATIONS = ["connects_with", "supports"]
# End of the fixed values.

EMPTY = "array<string>"


def facets(content: Column, source: Column, answered: Column) -> Column:
    """Rule facets and answered facets together, inside the allowlist, in allowlist order."""
    text = F.lower(F.concat_ws(" ", content, source))
    rules = F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(name)) for p, name in FACET_RULES]))
    allow = F.array(*[F.lit(x) for x in O.FACETS_ALLOWLIST])
    return F.array_intersect(allow, F.array_union(rules, F.coalesce(answered, F.array().cast(EMPTY))))


def domains(project: Column, answered: Column, own_project: str | None = None) -> Column:
    known = [*PROJECT_DOMAINS, *([own_project] if own_project else [])]
    allow = F.array(*[F.lit(x) for x in [*O.DOMAINS_ALLOWLIST, *([own_project] if own_project else [])]])
    rule = F.when(project.isin(known), F.array(project)).otherwise(F.array().cast(EMPTY))
    return F.array_intersect(allow, F.array_union(rule, F.coalesce(answered, F.array().cast(EMPTY))))


def unit_score(value: Column, default: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.cast("double"), F.lit(default))))


def merge_tags(tags: Column, added: Column) -> Column:
    have = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda w: F.trim(w)), lambda t: t != "")
    return F.array_join(F.array_distinct(F.concat(have, F.slice(added, 1, 5))), ", ")


def secondary_types(answered: Column, primary: Column) -> Column:
    valid = F.array(*[F.lit(t) for t in O.ACTIVE_TYPES])
    return F.slice(F.filter(F.array_intersect(answered, valid), lambda t: t != primary), 1, 2)


def apply_answers(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """Node updates from answers (id, summary, concepts, tags, facets, domains, score, layer, layer_confidence, changed)."""
    a = answers.select("id", *[F.col(c).alias(f"a_{c}") for c in answers.columns if c != "id"])
    sure = F.col("a_changed") & (F.col("a_layer_confidence") > 0.8)
    return nodes.join(a, "id").select(
        "id", F.substring("a_summary", 1, 100).alias("summary"), F.array_join(F.slice("a_concepts", 1, 5), ",").alias("key_concepts"),
        merge_tags(F.col("tags"), F.col("a_tags")).alias("tags"),
        F.array_join(facets(F.col("content"), F.col("source"), F.col("a_facets")), ",").alias("facets"),
        F.array_join(domains(F.col("project"), F.col("a_domains")), ",").alias("domains"),
        F.round(unit_score(F.col("a_score")), 6).alias("quality_score"),
        F.when(sure, F.col("a_layer")).otherwise(F.col("layer")).alias("layer"))


def pending(nodes: DataFrame) -> DataFrame:
    """Open work per phase: never enriched (no time of it), no embedding text, layer unchecked, secondary types missing."""
    status = F.coalesce("enrichment_status", F.lit("{}"))
    done = lambda task: F.contains(status, F.lit(f'"{task}"'))
    kinds = {"new": F.col("enriched_at").isNull(), "retry": status == "failed",
             "embedding_text": F.col("summary").isNotNull() & (F.size("key_concepts") > 0) & ~done("E7"),
             "layer_check": F.col("layer").isNotNull() & ~done("E12"), "secondary_types": ~done("E6")}
    marks = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    return G.active(nodes).select(F.explode(marks).alias("phase"), "id")


def hint_batches(nodes: DataFrame, size: int = 20) -> DataFrame:
    """Nodes without retrieval hints in id order, cut into batches."""
    rows = G.active(nodes).where("retrieval_hints IS NULL").select("id")
    return numbered(rows, "id", "pos").select("id", F.floor((F.col("pos") - 1) / size).cast("bigint").alias("batch"))


def refine_relations(edges: DataFrame, answers: DataFrame) -> DataFrame:
    """Generic edges whose answered relation is known, differs, and is flagged as changed (id, relation, changed)."""
    a = answers.select("id", F.col("relation").alias("new_relation"), "changed")
    rows = G.active(edges).where(F.col("relation").isin(GENERIC_RELATIONS)).join(a, "id")
    return rows.where(F.col("changed") & F.col("new_relation").isin(O.KNOWN_RELATIONS) & (F.col("new_relation") != F.col("relation"))).select(
        "id", F.col("relation").alias("old_relation"), "new_relation")


def edge_direction(answer: Column, source_layer: Column, target_layer: Column) -> Column:
    """Answered direction if it is one of the four, else by layers."""
    by_layer = (F.when(source_layer < target_layer, "upward").when(source_layer > target_layer, "downward").otherwise("horizontal"))
    return F.when(answer.isin(DIRECTIONS), answer).otherwise(by_layer)


def direct_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    s = nodes.select(F.col("id").alias("source_id"), F.col("layer").alias("sl"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("layer").alias("tl"))
    rows = G.active(edges).join(s, "source_id").join(t, "target_id")
    return rows.select("id", edge_direction(F.col("direction"), F.col("sl"), F.col("tl")).alias("direction"),
                       F.round(unit_score(F.col("strength")), 6).alias("strength"), F.round(unit_score(F.col("strength")), 6).alias("base_strength"))


def pair_edges(pairs: DataFrame, kind: str) -> DataFrame:
    """Edges from judged pairs (a, b, confidence): contradictions from 0.6 up, merge candidates at 0.7, assemblages at 0.8."""
    strength = {"contradicts": F.col("confidence"), "differs_in": F.lit(0.7), "assembles": F.lit(0.8)}[kind]
    rows = pairs.where("confidence >= 0.6") if kind == "contradicts" else pairs
    return rows.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit(kind).alias("relation"), strength.alias("strength"))


def domain_gaps(counts: DataFrame, least: int = 3) -> DataFrame:
    """Domains of (domain, type, n) that are large enough for a gap question, with their missing types."""
    per = counts.groupBy("domain").agg(F.sum("n").alias("nodes"), F.collect_set("type").alias("types")).where(F.col("nodes") >= least)
    every = F.array(*[F.lit(t) for t in sorted(O.ACTIVE_TYPES)])
    return per.select("domain", "nodes", F.array_join(F.array_except(every, "types"), ",").alias("missing_types"))
