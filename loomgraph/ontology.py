"""Ontology and policy constants, plus their use as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything from here to the matching end mark must agree with
# the published ontology, or scores and labels would differ.

PROMOTE_LAYER: dict[str, int | None] = {
    "Observation": 0, "Narrative": 0, "Question": 0,
    "Decision": 1, "Experiment": 1, "Failure": 1, "Signal": 1, "Goal": 1, "Tool": 1, "Project": 1,
    "Pattern": 2, "Insight": 2, "Framework": 2,
    "Principle": 3, "Identity": 3,
    "Unclassified": None,
}

VALID_PROMOTIONS: dict[str, list[str]] = {
    "Observation": ["Signal"],
    "Signal": ["Pattern", "Insight"],
    "Pattern": ["Principle", "Framework"],
    "Insight": ["Principle"],
}

RELATION_CATEGORIES: dict[str, list[str]] = {
    "causal": ["caused_by", "led_to", "triggered_by", "resulted_in",
               "resolved_by", "prevented_by", "enabled_by", "blocked_by"],
    "structural": ["part_of", "composed_of", "extends", "governed_by", "governs",
                   "instantiated_as", "expressed_as", "contains", "derived_from"],
    "layer_movement": ["realized_as", "crystallized_into", "abstracted_from",
                       "generalizes_to", "constrains", "generates"],
    "diff_tracking": ["differs_in", "variation_of", "evolved_from", "succeeded_by"],
    "semantic": ["supports", "contradicts", "analogous_to", "parallel_with",
                 "reinforces_mutually", "connects_with", "inspired_by", "exemplifies"],
    "perspective": ["viewed_through", "interpreted_as", "questions", "validates", "contextualizes"],
    "temporal": ["preceded_by", "simultaneous_with", "born_from", "assembles"],
    "cross_domain": ["transfers_to", "mirrors", "influenced_by", "showcases",
                     "correlated_with", "refuted_by"],
    "behavioral": ["co_retrieved"],
}
RELATION_FAMILY_NAMES = ["causes", "resolves", "supports", "contradicts", "abstracts", "expresses",
                         "evolves", "mirrors", "influences", "governs", "contains", "co_occurs"]
RELATION_STORAGE_CANONICAL = {
    "abstracts": "generalizes_to",
    "co_occurs": "connects_with",
    "expresses": "expressed_as",
    "influences": "correlated_with",
    "realizes": "expressed_as",
}

# source type -> target type -> relation
RELATION_RULES: dict[str, dict[str, str]] = {
    "Observation": {"Signal": "triggered_by", "Question": "led_to", "Experiment": "triggered_by"},
    "Signal": {"Pattern": "realized_as", "Insight": "realized_as", "Experiment": "led_to", "Decision": "led_to"},
    "Pattern": {"Principle": "crystallized_into", "Framework": "crystallized_into", "Decision": "governs"},
    "Insight": {"Principle": "crystallized_into", "Framework": "crystallized_into",
                "Decision": "led_to", "Narrative": "expressed_as"},
    "Decision": {"Pattern": "led_to", "Insight": "led_to", "Failure": "resulted_in", "Question": "led_to"},
    "Failure": {"Decision": "resolved_by", "Insight": "led_to", "Pattern": "led_to", "Question": "led_to"},
    "Question": {"Insight": "resolved_by", "Decision": "resolved_by", "Experiment": "led_to", "Goal": "led_to"},
    "Experiment": {"Insight": "led_to", "Failure": "resulted_in", "Pattern": "led_to", "Decision": "led_to"},
    "Goal": {"Experiment": "led_to", "Decision": "led_to", "Project": "led_to"},
    "Tool": {"Framework": "part_of", "Project": "part_of"},
    "Project": {"Goal": "governed_by", "Framework": "governed_by", "Decision": "contains"},
    "Framework": {"Principle": "governed_by", "Tool": "contains"},
    "Principle": {"Decision": "governs"},
    "Identity": {"Goal": "governs", "Decision": "governs", "Principle": "governed_by"},
    "Narrative": {"Insight": "exemplifies", "Pattern": "exemplifies", "Failure": "exemplifies",
                  "Decision": "contains", "Question": "contains"},
}
REVERSE_RELATION = {
    "triggered_by": "led_to", "led_to": "triggered_by",
    "realized_as": "abstracted_from", "abstracted_from": "realized_as",
    "crystallized_into": "abstracted_from",
    "resulted_in": "caused_by", "caused_by": "resulted_in",
    "resolved_by": "led_to",
    "part_of": "contains", "contains": "part_of",
    "governed_by": "governs", "instantiated_as": "abstracted_from",
    "exemplifies": "expressed_as", "expressed_as": "exemplifies",
    "extends": "derived_from",
}

# family -> member relations
RELATION_FAMILY_MEMBERS: dict[str, list[str]] = {
    "causes": ["led_to", "resulted_in", "triggered_by", "caused_by", "causes"],
    "resolves": ["resolved_by", "enabled_by", "blocked_by", "prevented_by", "resolves"],
    "contains": ["contains", "part_of", "composed_of", "assembles"],
    "supports": ["supports", "reinforces_mutually", "validates"],
    "contradicts": ["contradicts", "refuted_by"],
    "abstracts": ["generalizes_to", "abstracted_from", "crystallized_into", "abstracts"],
    "expresses": ["expressed_as", "instantiated_as", "exemplifies", "realizes",
                  "realized_as", "showcases", "expresses"],
    "evolves": ["succeeded_by", "preceded_by", "evolved_from", "derived_from", "born_from", "extends", "evolves"],
    "mirrors": ["mirrors", "analogous_to", "parallel_with", "variation_of", "differs_in"],
    "influences": ["influenced_by", "inspired_by", "transfers_to", "correlated_with", "influences"],
    "governs": ["governed_by", "governs", "constrains", "generates", "contextualizes", "questions"],
    "co_occurs": ["co_retrieved", "connects_with", "simultaneous_with",
                  "interpreted_as", "viewed_through", "co_occurs"],
}
RELATION_FAMILY_WEIGHT = {
    "causes": 1.5, "resolves": 1.3, "supports": 1.2, "contradicts": 1.2, "abstracts": 1.1,
    "expresses": 1.0, "evolves": 1.0, "governs": 1.0, "mirrors": 0.8, "influences": 0.8,
    "contains": 0.7, "co_occurs": 0.3,
}

# class -> member relations; a relation named nowhere counts as operational
EDGE_CLASS_MEMBERS: dict[str, list[str]] = {
    "semantic": ["supports", "contradicts", "reinforces_mutually", "led_to", "caused_by", "triggered_by",
                 "resulted_in", "resolved_by", "enabled_by", "blocked_by", "prevented_by", "generalizes_to",
                 "constrains", "generates", "governed_by", "governs", "analogous_to", "inspired_by",
                 "contextualizes", "mirrors", "influenced_by", "transfers_to", "correlated_with",
                 "refuted_by", "questions", "validates", "causes", "resolves", "influences"],
    "evidence": ["realized_as", "crystallized_into", "abstracted_from", "exemplifies", "expressed_as",
                 "instantiated_as", "derived_from", "showcases", "abstracts", "expresses"],
    "temporal": ["succeeded_by", "preceded_by", "evolved_from", "assembles", "born_from", "evolves"],
    "structural": ["contains", "part_of", "extends", "composed_of"],
    "operational": ["co_retrieved", "parallel_with", "connects_with", "simultaneous_with", "differs_in",
                    "variation_of", "interpreted_as", "viewed_through", "co_occurs"],
}
EDGE_CLASS_RANK = {"semantic": 4, "evidence": 3, "temporal": 2, "structural": 1, "operational": 0}
GRAPH_BONUS_BY_CLASS = {"semantic": 0.015, "evidence": 0.012, "temporal": 0.005,
                        "structural": 0.002, "operational": 0.0}
GRAPH_BONUS_DEFAULT = 0.005
GRAPH_EXCLUDED_METHODS = ["session_anchor", "legacy_unknown", "orphan_repair", "co_retrieval", "fallback"]
GENERATION_METHODS = ["manual", "rule", "semantic_auto", "session_anchor", "co_retrieval", "enrichment",
                      "fallback", "orphan_repair", "legacy_unknown", "migration", "external"]
GENERATION_METHOD_PENALTY = {"orphan_repair": -0.08, "legacy_unknown": -0.05, "fallback": -0.03,
                             "session_anchor": -0.05, "co_retrieval": -0.02, "enrichment": 0.0}

SOURCE_BONUS = {"user": 0.12, "claude": 0.08, "checkpoint": 0.04, "save_session": -0.02,
                "pdr": -0.02, "obsidian": -0.05, "hook": -0.04}
SOURCE_BONUS_DEFAULT = -0.03
LAYER_IMPORTANCE = {3: 0.6, 2: 0.4, 1: 0.2, 0: 0.1}
LAYER_IMPORTANCE_DEFAULT = 0.1
UNENRICHED_QUALITY = {0: 0.4, 1: 0.55, 2: 0.65, 3: 0.75}
TIER_BONUS = {0: 0.15, 1: 0.05, 2: 0.0}
TYPE_CHANNEL_WEIGHTS = {
    "Pattern": 1.0, "Decision": 1.0, "Signal": 0.8, "Failure": 0.8, "Experiment": 0.8, "Narrative": 0.8,
    "Goal": 0.8, "Observation": 0.8, "Question": 0.7, "Project": 0.7, "Identity": 0.7, "Insight": 0.6,
    "Framework": 0.6, "Principle": 0.5, "Tool": 0.5,
}
TYPE_CHANNEL_WEIGHT_DEFAULT = 0.5
MAX_TYPE_HINTS = 2
TYPE_KEYWORDS: dict[str, list[str]] = {
    "Tool": ["도구", "툴", "CLI", "스크립트", "명령어", "플러그인", "에이전트", "스킬"],
    "Failure": ["실패", "에러", "버그", "오류", "장애", "문제", "실수"],
    "Experiment": ["실험", "테스트", "검증", "비교", "시도"],
    "Decision": ["결정", "선택", "결단", "판단", "확정"],
    "Signal": ["신호", "징후", "조짐", "반복 관찰"],
    "Goal": ["목표", "계획", "방향", "비전"],
    "Pattern": ["패턴", "반복", "규칙", "관례", "워크플로우", "절차", "프로세스"],
    "Framework": ["프레임워크", "구조", "아키텍처", "설계", "스키마", "멘탈 모델"],
    "Project": ["프로젝트", "레포", "저장소", "버전"],
    "Narrative": ["서사", "맥락", "이야기", "세션 기록", "비유"],
    "Insight": ["통찰", "발견", "깨달음", "이해", "연결"],
    "Principle": ["원칙", "철학", "가치관", "기준", "믿음"],
    "Identity": ["정체성", "스타일", "습관", "선호", "성향"],
    "Observation": ["관찰", "기록", "증거", "데이터", "로그"],
    "Question": ["질문", "궁금", "미해결", "역설", "모순"],
}
SUGGEST_KEYWORDS: dict[str, list[str]] = {
    "Decision": ["결정", "decided", "decision", "chose", "선택", "확정"],
    "Failure": ["실패", "fail", "error", "버그", "mistake", "실수", "오류"],
    "Pattern": ["패턴", "pattern", "반복", "recurring", "규칙", "매번"],
    "Insight": ["통찰", "insight", "발견", "깨달음", "이해", "알게"],
    "Principle": ["원칙", "principle", "기준", "철학", "approach", "방침"],
    "Framework": ["프레임워크", "framework", "구조", "체계", "설계"],
    "Goal": ["목표", "goal", "달성", "aim", "objective"],
    "Signal": ["신호", "signal", "조짐", "경향", "징후"],
    "Experiment": ["실험", "experiment", "테스트", "시도", "검증"],
    "Observation": ["관찰", "observation", "noticed", "봤다", "기록"],
    "Identity": ["정체성", "identity", "스타일", "선호", "습관"],
    "Narrative": ["서사", "narrative", "이야기", "맥락", "비유"],
    "Question": ["질문", "question", "궁금", "미해결", "역설"],
}
PARTICLE_SUFFIXES = [
    "에서", "으로", "하는", "해서", "하고", "에게", "처럼", "까지",
    "부터", "만큼", "라는", "라고", "이라", "에는",
    "을", "를", "의", "이", "가", "은", "는", "에", "로", "와", "과",
    "도", "만", "며", "고", "면", "서", "나", "든",
]

RRF_K = 18
DEFAULT_TOP_K = 5
GRAPH_MAX_HOPS = 2
SIMILARITY_THRESHOLD = 0.55
TRAVERSAL_WIDTH = 20
DECAY_LAMBDA = 0.01
COMPOSITE_WEIGHT_DECAY = 0.001
COMPOSITE_WEIGHT_IMPORTANCE = 0.001
PROMOTED_MULTIPLIER = 1.5
QUALITY_WEIGHT = 0.2
CONFIDENCE_WEIGHT = 0.05
CONTRADICTION_PENALTY = -0.10
RERANK_WEIGHT, RERANK_GAP, RERANK_POOL = 0.35, 0.05, 3
PATCH_SATURATION = 0.75
UCB_FOCUS, UCB_AUTO, UCB_WIDE = 0.3, 1.0, 2.5

SPRT_ALPHA, SPRT_BETA, SPRT_P1, SPRT_P0, SPRT_MIN_OBS = 0.05, 0.2, 0.7, 0.3, 5
SPRT_HISTORY = 50
SWR_THRESHOLD = 0.25
DRIFT_THRESHOLD = 0.5
SUMMARY_LENGTH_MULTIPLIER, SUMMARY_LENGTH_MIN_SAMPLE = 2.0, 10

VERIFY_THRESHOLDS = {"ndcg@5": 0.25, "ndcg@10": 0.30, "hit_rate": 0.50, "null_layer_pct": 0.0,
                     "enrichment_coverage": 0.60, "orphan_pct": 0.10, "content_hash_coverage": 0.95,
                     "duplicate_pct": 0.0}
MATURITY_STEPS = [20, 50, 100]

GENERIC_EXCLUDED_ROLES = ["session_anchor", "work_item", "external_noise", "correction"]
GENERIC_EXCLUDED_PAIRS = [("pdr", "Narrative"), ("pdr", "Observation"), ("hook:PreCompact:relay", "Narrative")]
TROUBLESHOOTING_EXCLUDED_PAIRS = [("pdr", "Narrative"), ("hook:PreCompact:relay", "Narrative")]
SKIP_PATTERNS = ["미정", "확인", "검토", "점검", "여부", "TBD", "TODO"]
CAUSAL_RELATIONS = ["led_to", "caused_by", "triggered_by", "resulted_in", "resolved_by", "realized_as",
                    "crystallized_into", "evolved_from", "succeeded_by"]
FACETS_ALLOWLIST = ["philosopher", "developer", "designer", "writer", "system-architect", "researcher",
                    "aesthetician", "educator", "strategist"]
# the deployment's own project name is one more allowed domain: pass it as a parameter
DOMAINS_ALLOWLIST = ["orchestration", "portfolio", "tech-review", "monet-lab", "daily-memo",
                     "philosophy", "literature", "art", "general"]

# layer -> operation -> actors; "owner" stands for the human the deployment belongs to
LAYER_PERMISSIONS: dict[int, dict[str, list[str]]] = {
    0: {"read": ["all"], "write": ["owner", "claude", "system", "enrichment"], "delete": ["owner", "claude"],
        "modify_content": ["owner", "claude", "enrichment"],
        "modify_metadata": ["owner", "claude", "system", "enrichment"]},
    1: {"read": ["all"], "write": ["owner", "claude", "system", "enrichment"], "delete": ["owner", "claude"],
        "modify_content": ["owner", "claude", "enrichment"],
        "modify_metadata": ["owner", "claude", "system", "enrichment"]},
    2: {"read": ["all"], "write": ["owner", "claude"], "delete": ["owner"],
        "modify_content": ["owner", "claude"], "modify_metadata": ["owner", "claude", "system"]},
    3: {"read": ["all"], "write": ["owner", "claude"], "delete": ["owner"],
        "modify_content": ["owner", "claude"], "modify_metadata": ["owner", "claude"]},
    4: {"read": ["all"], "write": ["owner"], "delete": ["owner"],
        "modify_content": ["owner"], "modify_metadata": ["owner", "claude"]},
    5: {"read": ["all"], "write": ["owner"], "delete": ["owner"],
        "modify_content": ["owner"], "modify_metadata": ["owner", "claude"]},
}
# End of the fixed values.

SCHEMA_RELATIONS = [r for members in RELATION_CATEGORIES.values() for r in members]
KNOWN_RELATIONS = sorted(set(SCHEMA_RELATIONS) | set(RELATION_FAMILY_NAMES))
RELATION_FAMILY = {r: fam for fam, members in RELATION_FAMILY_MEMBERS.items() for r in members}
EDGE_CLASS = {r: cls for cls, members in EDGE_CLASS_MEMBERS.items() for r in members}
ACTIVE_TYPES = [t for t in PROMOTE_LAYER if t != "Unclassified"]


def sql_literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def lookup(table: Mapping, key: Column, default=None) -> Column:
    """Constant-table lookup; stays JVM-side and folds into the surrounding projection."""
    pairs = ", ".join(sql_literal(x) for kv in table.items() if kv[1] is not None for x in kv)
    found = F.try_element_at(F.expr(f"map({pairs})"), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def edge_class(relation: Column) -> Column:
    return lookup(EDGE_CLASS, relation, "operational")


def family_weight(relation: Column) -> Column:
    weight = {r: RELATION_FAMILY_WEIGHT[f] for r, f in RELATION_FAMILY.items()}
    return lookup(weight, relation, RELATION_FAMILY_WEIGHT["co_occurs"])


def canonical_relation(relation: Column) -> Column:
    """Alias folded to its stored name; anything unknown falls back to connects_with."""
    folded = F.coalesce(lookup(RELATION_STORAGE_CANONICAL, relation), relation)
    return F.when(folded.isin(KNOWN_RELATIONS), folded).otherwise(F.lit("connects_with"))


def infer_relation(src_type: Column, src_layer: Column, tgt_type: Column, tgt_layer: Column,
                   src_project: Column, tgt_project: Column) -> Column:
    """Relation suggested by the type rules, else by layers, else by projects."""
    forward = {f"{s}>{t}": r for s, row in RELATION_RULES.items() for t, r in row.items()}
    backward = {f"{t}>{s}": REVERSE_RELATION.get(r, r) for s, row in RELATION_RULES.items() for t, r in row.items()}
    pair = F.concat_ws(">", src_type, tgt_type)
    named = (F.coalesce(src_project, F.lit("")) != "") & (F.coalesce(tgt_project, F.lit("")) != "")
    crossing = named & (src_project != tgt_project)
    level = (F.when(src_layer < tgt_layer, "generalizes_to")
             .when(src_layer > tgt_layer, "expressed_as")
             .when((src_layer == tgt_layer) & (src_type == tgt_type),
                   F.when(crossing, "mirrors").otherwise("supports"))
             .when((src_layer == tgt_layer) & crossing, "correlated_with")
             .when((src_layer == tgt_layer) & named & (src_project == tgt_project), "contains")
             .otherwise("connects_with"))
    return F.coalesce(lookup(forward, pair), lookup(backward, pair), level)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words occurs, as one alternation of quoted words."""
    return F.rlike(text, F.lit("|".join(f"\\Q{w}\\E" for w in words)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
