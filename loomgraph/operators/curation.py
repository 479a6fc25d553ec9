"""Duplicate, staleness and pollution clean-up: every function lists what would change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators.lifecycle import older_than
from loomgraph.operators.scale import duplicate_groups

# Patterns and rule labels of the clean-up policies.
CONTROL_DOCS = ["obsidian:AGENTS.md", "obsidian:CLAUDE.md", "obsidian:GEMINI.md", "obsidian:HOME.md",
                "obsidian:.rulesync\\"]
CONTROL_PREFIXES = ["obsidian:.agents\\skills\\", "obsidian:.claude\\rules\\", "obsidian:.codex\\memories\\",
                    "obsidian:.rulesync\\rules\\"]
TASK_PATTERNS = [r"(^|\n)##\s*Task\b", r"\*\*Files:\*\*", r"(^|\n)\*\*Step\s+\d+",
                 r"(^|\n)\s*[-*]\s*(Create|Modify|Delete|Rename):", r"`C:\\dev\\"]
FENCED_CODE = r"```(bash|tsx|html|yaml|typescript|javascript|liquid)"
TACTICAL = ["확인", "검토", "점검", "검증", "여부", "필요", "미정", "미완", "미구현",
            "수정", "조정", "반영", "연결", "구현", "실행", "재실행", "재수집",
            "커밋", "푸시", "push", "배포", "동기화", "적용", "삭제", "롤백",
            "untracked", "빌드 에러", "스케줄", "schedule", "enable", "disable",
            "정비", "정리", "미실행", "미확인", "누락", "실패", "버그", "잔여",
            "로드맵", "일정", "유지 vs", "실측", "미커밋"]
STRONG_TACTICAL = ["미완", "미구현", "미실행", "미확인", "재실행", "재수집", "누락",
                   "정리 필요", "반영 필요", "추가 필요", "수정 필요", "실패", "버그",
                   "잔여", "로드맵", "일정", "유지 vs", "실측", "미커밋"]
DURABLE = ["온톨로지", "기억", "memory", "recall", "pattern", "principle",
           "layer", "gate", "threshold", "quality", "weight", "weights", "bonus",
           "swr", "ndcg", "goldset", "checkpoint", "가중치", "bias", "enrichment",
           "정책", "규칙", "원칙", "철학", "역할", "스코프", "금지", "workflow",
           "relation", "node", "edge", "tone", "독자", "서사", "글쓰기",
           "컨텍스트", "구조", "시스템", "단일 소스", "타입 매핑", "패턴",
           "sot", "scope"]
FILE_HINT = (r"(?i)(\b(scene|diagram|hero|toc|svg|github|vercel|readme|master|origin|schedule|cron)\b|"
             r"[A-Za-z0-9_./-]+\.(md|py|tsx|ts|js|json|html|css|ya?ml))")
MIN_ITEM_LENGTH = 40
TACTICAL_LENGTH = {"Question": 90, "Decision": 70}
# End of the fixed values.


def stale(nodes: DataFrame, as_of: str, days: int) -> DataFrame:
    """Active nodes never visited, older than ``days``, neither core nor validated."""
    return G.active(nodes).where((F.coalesce("visit_count", F.lit(0)) == 0) & older_than(as_of, F.col("created_at"), days)
                                 & (F.coalesce("node_role", F.lit("")) != "knowledge_core")
                                 & (F.coalesce("epistemic_status", F.lit("")) != "validated"))


def starts_with_any(source: Column, prefixes: list[str]) -> Column:
    low = F.lower(source)
    return O.any_of([F.startswith(low, F.lit(p.lower())) for p in prefixes])


def normalised_hash(content: Column) -> Column:
    return F.sha1(T.squeeze(F.coalesce(content, F.lit(""))))


def stale_duplicates(nodes: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Copies (same project, type, normalised text) among stale documents, each with the one to keep."""
    src = F.coalesce("source", F.lit(""))
    low = F.lower(src)
    archived = O.contains_any(low, ["_archived", "_history\\\\", "changelog.md"])
    variant = F.contains(low, F.lit("\\page-")) & F.contains(low, F.lit("-v"))
    pool = (stale(nodes, as_of, days)
            .where(F.startswith(low, F.lit("obsidian:")) & ~starts_with_any(F.col("source"), CONTROL_DOCS)
                   & (F.trim(F.coalesce("content", F.lit(""))) != ""))
            .select("id", "project", "type", "source", normalised_hash(F.col("content")).alias("content_key")))
    order = [archived.cast("int").alias("o1"), variant.cast("int").alias("o2"), F.length(src).alias("o3"), F.col("id")]
    return duplicate_groups(pool, ["project", "type", "content_key"], order, ["id", "source"]).select(
        "project", "type", "content_key", "group_size", "keep_id", "id",
        F.when(F.col("id") == F.col("keep_id"), "keep").otherwise("archive").alias("action"))


def same_source_duplicates(nodes: DataFrame) -> DataFrame:
    """Exact copies inside one source; the most visited, then best rated, then oldest id stays."""
    pool = G.active(nodes).select("id", "source", "visit_count", "quality_score",
                                  F.sha1(F.trim(F.coalesce("content", F.lit("")))).alias("content_key"))
    order = [(-F.coalesce("visit_count", F.lit(0))).alias("o1"), (-F.coalesce("quality_score", F.lit(0.0))).alias("o2"), F.col("id")]
    return duplicate_groups(pool, ["source", "content_key"], order, ["id"]).select(
        "source", "content_key", "group_size", "keep_id", "id",
        F.when(F.col("id") == F.col("keep_id"), "keep").otherwise("archive").alias("action"))


def hash_duplicates(nodes: DataFrame) -> DataFrame:
    return (nodes.where("content_hash IS NOT NULL").groupBy("content_hash")
            .agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1"))


def labelled(rows: DataFrame, rules: dict[str, Column], label: str = "rule") -> DataFrame:
    """One row per rule that holds, in one pass over the table."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rows.withColumn(label, F.explode(hit))


def history_rules(source: Column) -> dict[str, Column]:
    low = F.lower(source)
    history = F.startswith(low, F.lit("obsidian:")) & low.rlike("obsidian:.*.history")
    inner = F.startswith(low, F.lit("obsidian:")) & low.rlike(r"obsidian:.*.history\\archive")
    archived = F.startswith(low, F.lit("obsidian:")) & low.rlike("obsidian:.*.archived")
    return {"obsidian_history": history & ~inner, "obsidian_archived": inner | archived,
            "obsidian_changelog": F.startswith(low, F.lit("obsidian:")) & F.contains(low, F.lit("changelog.md"))}


def stale_history(nodes: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return labelled(stale(nodes, as_of, days), history_rules(F.col("source"))).select("id", "source", "rule")


def taskish(content: Column, patterns: list[str]) -> Column:
    return O.any_of([F.coalesce(content, F.lit("")).rlike("(?i)" + p) for p in patterns])


def stale_plan_tasks(nodes: DataFrame, as_of: str, days: int = 30, source_like: str = "obsidian:%plans%",
                     patterns: list[str] | None = None) -> DataFrame:
    pool = stale(nodes, as_of, days).where(F.col("source").ilike(source_like) & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    return pool.withColumn("taskish", taskish(F.col("content"), patterns or TASK_PATTERNS)).select("id", "source", "taskish")


def retention(nodes: DataFrame, as_of: str, days: int, keep: dict[str, Column], archive: dict[str, Column]) -> DataFrame:
    """Stale rows an archive rule names, unless any keep rule protects them."""
    open_ = stale(nodes, as_of, days).where(~O.any_of(list(keep.values())))
    return labelled(open_, archive, "rule_label").select("id", "source", "type", "rule_label")


def orphan_control_docs(nodes: DataFrame, edges: DataFrame, as_of: str, prefixes: list[str] | None = None) -> DataFrame:
    rows = G.active(nodes).where((F.coalesce("visit_count", F.lit(0)) == 0)
                                 & (F.col("created_at").isNull() | ~(F.col("created_at") > F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")))
                                 & starts_with_any(F.col("source"), prefixes or CONTROL_PREFIXES))
    linked = G.touched(G.live_edges(nodes, edges))
    preview = F.substring(F.replace(F.col("content"), F.lit("\n"), F.lit(" ")), 1, 160)
    return rows.join(linked, "id", "left_anti").select("id", "project", "source", "type", preview.alias("preview"))


def item_role(content: Column, kind: Column) -> Column:
    """Work item or knowledge candidate, by length, tactical and durable wording."""
    text = F.trim(F.coalesce(content, F.lit("")))
    low = F.lower(text)
    hint = text.rlike(FILE_HINT)
    tactical = O.contains_any(low, TACTICAL) | hint
    strong = O.contains_any(low, STRONG_TACTICAL) | hint
    durable = O.contains_any(F.regexp_replace(low, FILE_HINT, " "), DURABLE)
    limit = O.lookup(TACTICAL_LENGTH, kind, TACTICAL_LENGTH["Decision"])
    work = ((F.length(text) < MIN_ITEM_LENGTH) | ((kind == "Question") & tactical & ~durable) | (strong & ~durable)
            | ((F.length(text) < limit) & tactical & ~durable))
    return F.when(work, "work_item").otherwise("knowledge_candidate")


def skip_item(content: Column) -> Column:
    text = F.trim(F.coalesce(content, F.lit("")))
    return (text == "") | O.contains_any(text, O.SKIP_PATTERNS)


def session_items(nodes: DataFrame, role: str) -> DataFrame:
    return G.active(nodes).where((F.col("source") == "save_session") & (F.coalesce("node_role", F.lit("")) == role)
                                 & F.col("type").isin("Decision", "Question"))


def hook_nodes(nodes: DataFrame, project: str = "dev") -> DataFrame:
    return G.active(nodes).where((F.col("project") == project) & (F.col("source_kind") == "hook")).select("id", "source", "type", "node_role")


def edges_touching_inactive(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active edges with an end that is a known but inactive node, found by two semi joins."""
    gone = nodes.where("status <> 'active'").select("id")
    act = G.active(edges)
    cols = ["id", "source_id", "target_id", "relation"]
    by_source = act.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(cols)
    by_target = act.join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(cols)
    return by_source.unionAll(by_target).distinct()


def normalise_relations(nodes: DataFrame, edges: DataFrame, known: list[str]) -> DataFrame:
    """Active edges whose relation is not in the catalog but has a canonical name."""
    odd = G.active(edges).where(~F.col("relation").isin(known))
    s = nodes.select(F.col("id").alias("source_id"), F.col("layer").alias("sl"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("layer").alias("tl"))
    new = F.when(F.col("relation") == "realizes", F.when(F.col("sl") < F.col("tl"), "realized_as").otherwise("expressed_as")
                 ).otherwise(O.lookup(O.RELATION_STORAGE_CANONICAL, F.col("relation")))
    return (odd.join(s, "source_id").join(t, "target_id").withColumn("new_relation", new).where("new_relation IS NOT NULL")
            .select("id", F.col("relation").alias("old_relation"), "new_relation", "source_id", "target_id"))


def audit_repair_edges(nodes: DataFrame, edges: DataFrame, method: str = "orphan_repair") -> DataFrame:
    """Buckets and decision for every repair edge; an edge that is the last one of an end is protected."""
    rules = [f"{s}>{t}" for s, row in O.RELATION_RULES.items() for t in row]
    act = G.active(edges)
    deg = G.endpoints(act).groupBy("nid").agg(F.count("*").alias("deg"))
    a = nodes.select(F.col("id").alias("source_id"), F.col("type").alias("st"), F.coalesce("project", F.lit("")).alias("sp"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("type").alias("tt"), F.coalesce("project", F.lit("")).alias("tp"))
    s = F.coalesce("strength", F.lit(0.0))
    typed = F.concat_ws(">", "st", "tt").isin(rules) | F.concat_ws(">", "tt", "st").isin(rules)
    rows = (act.where(F.col("generation_method") == method).join(a, "source_id").join(b, "target_id")
            .join(deg.select(F.col("nid").alias("source_id"), F.col("deg").alias("d1")), "source_id")
            .join(deg.select(F.col("nid").alias("target_id"), F.col("deg").alias("d2")), "target_id"))
    reason = F.when(s < 0.15, "ultra-weak").when((s < 0.3) & ~typed, "weak + untyped")
    return rows.withColumn("reason", reason).select(
        "id", F.when(s < 0.3, "weak").when(s < 0.5, "marginal").otherwise("ok").alias("strength_bucket"),
        F.when(typed, "typed").otherwise("untyped").alias("type_bucket"),
        F.when(F.col("sp") == F.col("tp"), "same_project").otherwise("cross_project").alias("project_bucket"), "reason",
        F.when(F.col("reason").isNull(), "keep").when((F.col("d1") <= 1) | (F.col("d2") <= 1), "protected")
        .otherwise("delete").alias("decision"))


def orphans_after(nodes: DataFrame, edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Active nodes left without an active edge once the listed edges are gone."""
    rest = G.active(edges).join(deleted.select("id"), "id", "left_anti")
    return G.active(nodes).select("id").join(G.touched(rest), "id", "left_anti")


def undo_evaluation(nodes: DataFrame, log: DataFrame, queries: list[str]) -> DataFrame:
    """Visits to take back from nodes that evaluation queries hit."""
    hits = log.where(F.col("query").isin(queries)).groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("eval_hits"))
    before = F.coalesce("visit_count", F.lit(0))
    after = F.greatest(before - F.col("eval_hits"), F.lit(0))
    return nodes.join(hits, "id").select("id", "eval_hits", before.alias("visits_before"), after.alias("visits_after"))


def undo_evaluation_totals(nodes: DataFrame, log: DataFrame, queries: list[str], total_recalls: int) -> DataFrame:
    pool = log.where(F.col("query").isin(queries))
    head = pool.agg(F.count("*").alias("log_rows"), F.count_distinct("node_id").alias("nodes_hit"),
                    F.count_distinct("recall_id").alias("recalls"),
                    F.count(F.when(F.col("recall_id").isNull(), 1)).alias("rows_without_recall"))
    delta = undo_evaluation(nodes, log, queries).agg(F.sum(F.col("visits_before") - F.col("visits_after")).alias("visit_delta"))
    return head.withColumn("total_after", F.greatest(F.lit(total_recalls) - F.col("recalls"), F.lit(0))).withColumn(
        "visit_delta", F.coalesce(F.lit(delta.scalar()), F.lit(0)).cast("bigint"))


def reset_edge_learning(edges: DataFrame) -> DataFrame:
    """Active edges whose counters or strength go back to their base."""
    off = F.col("base_strength").isNotNull() & (F.abs(F.coalesce("strength", F.lit(0.0)) - F.coalesce("base_strength", F.lit(0.0))) > 1e-6)
    used = (F.coalesce("frequency", F.lit(0)) != 0) | F.col("last_activated").isNotNull()
    return G.active(edges).where(off | used).select(
        "id", F.when(off, F.col("base_strength")).otherwise(F.col("strength")).alias("strength"),
        F.lit(0).alias("frequency"), used.alias("counter_reset"), off.alias("strength_restored"))


def edge_learning_stats(edges: DataFrame) -> DataFrame:
    off = F.col("base_strength").isNotNull() & (F.abs(F.coalesce("strength", F.lit(0.0)) - F.col("base_strength")) > 1e-6)
    n = lambda c: F.count(F.when(c, 1))
    return G.active(edges).agg(
        F.count("*").alias("active_edges"), n(F.coalesce("frequency", F.lit(0)) > 0).alias("edges_with_frequency"),
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("frequency_sum"), n(F.col("last_activated").isNotNull()).alias("last_activated_nonnull"),
        n(off).alias("strength_restore_candidates"), n(F.col("generation_method") == "co_retrieval").alias("co_retrieval_active"))


def vector_tombstones(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    return vectors.select("id").join(G.active(nodes).select("id"), "id", "left_anti")
