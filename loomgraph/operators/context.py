"""Context assembly: session sections, context-pack slots, policy rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators.lifecycle import older_than
from loomgraph.operators.scale import top_per_group

# Slot order, rule kinds and wordings.
SLOT_PRIORITY = ["task_frame", "preferences_and_boundaries", "applicable_principles", "open_conflicts",
                 "project_workflows", "relevant_episodes"]
RULE_BY_DIMENSION = {"preference": "prefer", "emotion": "avoid", "thinking_style": "do", "decision_style": "do",
                     "language": "prefer", "rhythm": "do", "metacognition": "do", "connection": "do"}
NEGATIVE_WORDS = ["싫어", "금지", "하지 마", "안 한다", "거부", "불필요", "낭비"]
TIMELINE_LABELS = {"decision_recorded": "decision", "failure_recorded": "failure", "question_recorded": "question",
                   "pipeline_advanced": "pipeline", "session_start": "session_start", "session_end": "session_end"}
BOUNDARY_DIMENSIONS = ["preference", "emotion"]
# End of the fixed values.


def _preview(limit: int, *cols: str) -> Column:
    first, *rest = [F.nullif(c, F.lit("")) for c in cols]
    return F.substring(F.coalesce(first, *rest) if rest else first, 1, limit)


def sections(nodes: DataFrame, edges: DataFrame, as_of: str, project: str = "") -> DataFrame:
    """The node sections shown at the start of a session, each with its own filter, order and limit."""
    a = G.active(nodes)
    if project:
        a = a.where(F.col("project") == project)
    fresh = ~F.col("epistemic_status").isin("outdated", "superseded", "flagged")
    role = F.col("node_role")
    plain = ~role.isin("work_item", "external_noise")
    newest = [F.desc("created_at"), F.col("id")]
    since = lambda d: ~older_than(as_of, F.col("created_at"), d)
    core_types = F.col("type").isin("Pattern", "Insight", "Principle", "Identity", "Framework")
    visits = [F.desc_nulls_last("visit_count"), F.col("id")]
    spec = [
        ("knowledge_core", (role == "knowledge_core") & fresh, visits, 30, _preview(100, "summary", "content")),
        ("l2_core", (F.col("layer") >= 2) & core_types & fresh & plain, [F.desc_nulls_last("quality_score"), F.col("id")], 15,
         _preview(80, "summary", "content")),
        ("signals", (F.col("type") == "Signal") & since(30), newest, 10, _preview(80, "summary", "content")),
        ("observations", (F.col("type") == "Observation") & since(7), newest, 5, _preview(80, "summary", "content")),
        ("decisions", (F.col("type") == "Decision") & plain, newest, 3, _preview(80, "content")),
        ("questions", (F.col("type") == "Question") & plain, newest, 3, _preview(80, "content")),
        ("failures", F.col("type") == "Failure", newest, 2, _preview(80, "content")),
        ("insights", F.col("type") == "Insight", newest, 2, _preview(80, "content")),
        ("promotion_ready", F.col("type").isin("Signal", "Pattern", "Observation") & (F.col("visit_count") >= 5),
         [F.desc("visit_count"), F.col("id")], 3, _preview(80, "content")),
    ]
    out = None
    for name, cond, order, limit, text in spec:
        rows = a.where(cond).orderBy(*order).limit(limit).select(F.lit(name).alias("section"), "id", text.alias("preview"))
        out = rows if out is None else out.unionAll(rows)
    return out.unionAll(corrections(a, edges).select(F.lit("corrections").alias("section"), "id", "preview"))


def corrections(active_nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Latest corrections with the node each one contradicts."""
    contra = G.active(edges).where("relation = 'contradicts'").select(F.col("source_id").alias("id"), F.col("target_id").alias("flagged"))
    rows = active_nodes.where("type = 'Correction'").select("id", "created_at", _preview(80, "content").alias("preview"))
    return rows.join(contra, "id", "left").orderBy(F.desc("created_at"), "id", "flagged").limit(limit)


def repeated_failures(nodes: DataFrame, as_of: str, days: int = 30, least: int = 3, limit: int = 3) -> DataFrame:
    rows = G.active(nodes).where((F.col("type") == "Failure") & ~older_than(as_of, F.col("created_at"), days))
    return (rows.groupBy("project").agg(F.count("*").alias("failures")).where(F.col("failures") >= least)
            .orderBy(F.desc("failures"), "project").limit(limit))


def last_session(sessions: DataFrame, project: str = "") -> DataFrame:
    rows = sessions.where(F.col("project") == project) if project else sessions
    piped = rows.where("active_pipeline <> ''").agg(F.max_by("active_pipeline", "id")).scalar()
    return rows.orderBy(F.desc("id")).limit(1).select(
        "session_id", F.substring("summary", 1, 200).alias("summary"),
        F.coalesce(F.nullif("active_pipeline", F.lit("")), F.lit(piped), F.lit("")).alias("pipeline"))


def timeline(log: DataFrame, session_id: str, limit: int = 20) -> DataFrame:
    """First labelled actions of a session."""
    rows = log.where((F.col("session_id") == session_id) & F.col("action_type").isin(list(TIMELINE_LABELS)))
    rows = rows.orderBy("created_at", "id").limit(limit)
    return rows.select("id", F.date_format("created_at", "HH:mm").alias("time"), O.lookup(TIMELINE_LABELS, F.col("action_type")).alias("type"),
                       F.get_json_object("params", "$.type").alias("node_type"), F.substring("context", 1, 80).alias("summary"))


# --- context pack ----------------------------------------------------------

def approved(traits: DataFrame) -> DataFrame:
    return traits.where("status = 'verified' AND approval = 'approved'")


def rejects(feedback: DataFrame) -> DataFrame:
    return feedback.where("feedback_type = 'reject' AND target_type = 'trait'").select(F.col("target_id").alias("id")).distinct()


def principles(traits: DataFrame, per_dimension: int = 2) -> DataFrame:
    rows = approved(traits).where("dimension <> 'unclassified'").select("id", "dimension", "content", "verified_at")
    return top_per_group(rows, ["dimension"], [F.desc("verified_at"), F.col("id")], per_dimension)


def project_decisions(nodes: DataFrame, keywords: list[str], limit: int = 5) -> DataFrame:
    hit = O.contains_any(F.lower("content"), [k.lower() for k in keywords])
    return G.active(nodes).where((F.col("type") == "Decision") & hit).orderBy(F.desc("created_at"), "id").limit(limit)


def episodes(captures: DataFrame, sessions: DataFrame, actor: str = "owner", limit: int = 5) -> DataFrame:
    said = captures.where((F.col("actor") == actor) & (F.length("content") > 10)).orderBy(F.desc("created_at"), "id").limit(limit)
    past = sessions.where("coalesce(summary, '') <> ''").orderBy(F.desc("started_at"), "id").limit(3)
    return said.select(F.lit("message").alias("kind"), "id", F.substring("content", 1, 200).alias("content")).unionAll(
        past.select(F.lit("session_summary").alias("kind"), F.col("session_id").alias("id"), F.substring("summary", 1, 200).alias("content")))


def pack(traits: DataFrame, conflicts: DataFrame, feedback: DataFrame, nodes: DataFrame, captures: DataFrame,
         sessions: DataFrame, conflict_limit: int = 5) -> DataFrame:
    """Slots of the context pack after rejects, precedence and conflict escalation.

    Rejected traits leave by anti join; unresolved conflicts of the traits that
    remain are added to the open ones; the three newest questions close the list.
    """
    gone = rejects(feedback)
    bounds = approved(traits).where(F.col("dimension").isin(BOUNDARY_DIMENSIONS)).orderBy(F.desc("verified_at"), "id").limit(8)
    slots = [("applicable_principles", principles(traits)), ("preferences_and_boundaries", bounds)]
    trait_rows = None
    for name, df in slots:
        rows = df.join(gone, "id", "left_anti").select(F.lit(name).alias("slot"), "id", F.substring("content", 1, 200).alias("content"), "verified_at")
        trait_rows = rows if trait_rows is None else trait_rows.unionAll(rows)
    order = Window.partitionBy("slot").orderBy(F.desc("verified_at"), "id")  # two per dimension, eight bounds
    trait_rows = trait_rows.withColumn("pos", F.row_number().over(order)).select("slot", "pos", "id", "content")
    open_ = conflicts.where("resolved = 0")
    listed = open_.orderBy("id").limit(conflict_limit)
    raised = open_.join(trait_rows.select(F.col("id").alias("trait_id")).distinct(), "trait_id", "left_semi")
    both = listed.select("id", "description").union(raised.select("id", "description")).distinct()
    conflict_rows = both.select(F.lit("open_conflicts").alias("slot"), F.lit(0).alias("pos"), F.col("id").cast("string").alias("id"),
                                F.col("description").alias("content"))
    asked = G.active(nodes).where("type = 'Question'").orderBy(F.desc("created_at"), "id").limit(3).select(
        F.lit("open_conflicts").alias("slot"), F.lit(1).alias("pos"), F.concat(F.lit("node:"), F.col("id").cast("string")).alias("id"),
        F.substring("content", 1, 150).alias("content"))
    told = episodes(captures, sessions).select(F.lit("relevant_episodes").alias("slot"), F.lit(0).alias("pos"), "id", "content")
    return trait_rows.unionAll(conflict_rows).unionAll(asked).unionAll(told)


def trim_plan(slots: DataFrame, budget: int) -> DataFrame:
    """Which slots of (slot, tokens, placeholder_tokens) are cut to a placeholder, lowest priority first.

    A slot is cut while the total before it still exceeds the budget: the cuts
    below it in priority have been made, each leaving its placeholder. There
    are six slots, so the window is over six rows.
    """
    rank = {s: i for i, s in enumerate(SLOT_PRIORITY)}
    rows = slots.withColumn("prio", O.lookup(rank, F.col("slot")))
    below = Window.orderBy(F.desc("prio")).rowsBetween(Window.unboundedPreceding, -1)
    saved = F.coalesce(F.sum(F.col("tokens") - F.col("placeholder_tokens")).over(below), F.lit(0))
    total = F.sum("tokens").over(Window.partitionBy())
    return rows.withColumn("before", total - saved).withColumn("trimmed", F.col("before") > budget).select(
        "slot", "tokens", "trimmed", F.when(F.col("trimmed"), F.col("placeholder_tokens")).otherwise(F.col("tokens")).alias("tokens_after"))


def slot_tokens(rows: DataFrame) -> DataFrame:
    """Token estimate per slot from its item texts, with the size of a placeholder."""
    size = rows.groupBy("slot").agg(F.sum(F.length("content")).alias("chars"), F.count("*").alias("items"))
    mark = F.length(F.concat(F.lit('{"_trimmed": true, "_count": '), F.col("items").cast("string"), F.lit("}")))
    return size.select("slot", F.greatest(F.lit(1), F.floor(F.col("chars") / 2)).cast("bigint").alias("tokens"),
                       F.greatest(F.lit(1), F.floor(mark / 2)).cast("bigint").alias("placeholder_tokens"))


def rule_type(dimension: Column, content: Column) -> Column:
    negative = O.contains_any(content, NEGATIVE_WORDS)
    return F.when(negative, F.when(dimension == "emotion", "avoid").otherwise("dont")).otherwise(
        O.lookup(RULE_BY_DIMENSION, dimension, "do"))


def rule_name(trait_id: Column, content: Column) -> Column:
    clean = F.regexp_replace(F.substring(content, 1, 60), r"[^a-zA-Z가-힣0-9\s]", "")
    words = F.slice(F.filter(F.split(T.squeeze(clean), " "), lambda w: w != ""), 1, 5)
    base = F.coalesce(F.nullif(F.lower(F.array_join(words, "_")), F.lit("")), F.lit("trait"))
    return F.concat(F.lit("auto_"), base, F.lit("_"), F.substring(trait_id, 1, 8))


def compile_policy(traits: DataFrame, feedback: DataFrame, conflicts: DataFrame) -> DataFrame:
    open_ = conflicts.where("resolved = 0").select(F.col("trait_id").alias("id")).distinct()
    rows = approved(traits).join(rejects(feedback), "id", "left_anti").join(open_, "id", "left_anti")
    return rows.select("id", "dimension", rule_name(F.col("id"), F.col("content")).alias("name"),
                       rule_type(F.col("dimension"), F.col("content")).alias("rule_type"))
