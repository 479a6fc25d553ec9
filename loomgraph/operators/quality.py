"""Data-quality checks and reports. Checks come as rows (name, category, score, threshold, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.operators import graph as G
from loomgraph.operators.lifecycle import older_than
from loomgraph.operators.scale import weighted_percentiles

CHECK_COLS = ["name", "category", "score", "threshold", "status"]


def verdict(score: Column, threshold: Column, higher: bool = True) -> Column:
    """PASS, or WARN within a fifth of the threshold, else FAIL."""
    bad, worse = (score < threshold, score < threshold * 0.8) if higher else (score > threshold, score > threshold * 1.2)
    return F.coalesce(F.when(bad, F.when(worse, "FAIL").otherwise("WARN")), F.lit("PASS"))


def scored(name: str, category: str, score: Column, threshold: float, higher: bool = True) -> Column:
    limit = F.lit(threshold)
    return F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), F.round(score, 6).alias("score"),
                    limit.alias("threshold"), verdict(score, limit, higher).alias("status"))


def stated(name: str, category: str, value: Column, status: Column) -> Column:
    """A check that reports a value and sets its status itself."""
    return F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), F.round(value.cast("double"), 6).alias("score"),
                    F.lit(None).cast("double").alias("threshold"), status.alias("status"))


def as_rows(one: DataFrame, checks: list[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*checks)).alias("c")).select(*[F.col(f"c.{c}").alias(c) for c in CHECK_COLS])


def n_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def with_scalar(df: DataFrame, name: str, one: DataFrame) -> DataFrame:
    """Attach the value of a one-row frame."""
    return df.withColumn(name, F.lit(one.scalar()))


def data_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    act = F.col("status") == "active"
    one = nodes.agg(
        n_if(act).alias("total"), n_if(act & F.col("layer").isNull() & (F.col("type") != "Unclassified")).alias("null_layer"),
        n_if(act & F.col("content_hash").isNotNull()).alias("hashed"))
    groups = G.active(nodes).where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count("*").alias("c")).where("c > 1")
    one = with_scalar(one, "dups", groups.agg(F.count("*")))
    gone = nodes.where("status = 'deleted'").select("id")
    dangling = G.endpoints(G.active(edges)).join(gone.withColumnRenamed("id", "nid"), "nid", "left_semi").agg(F.count_distinct("edge_id"))
    one = with_scalar(one, "dangling", dangling)
    one = with_scalar(one, "orphans", G.orphans(nodes, edges, "active").agg(F.count("*")))
    th = O.VERIFY_THRESHOLDS
    return as_rows(one, [
        scored("null_layer_pct", "data", share(F.col("null_layer"), F.col("total")), th["null_layer_pct"], False),
        scored("content_hash_coverage", "data", share(F.col("hashed"), F.col("total"), 1.0), th["content_hash_coverage"]),
        scored("duplicate_content_hash_groups", "data", F.col("dups").cast("double"), 0.0),
        # the check above cannot fail as defined; this one reads the same figure the right way round
        scored("duplicate_content_hash_groups_strict", "data", F.col("dups").cast("double"), 0.0, False),
        stated("deleted_node_edges_cleaned", "data", F.col("dangling"), F.when(F.col("dangling") == 0, "PASS").otherwise("WARN")),
        scored("orphan_pct", "data", share(F.col("orphans"), F.col("total")), th["orphan_pct"], False)])


def _blank(name: str) -> Column:
    kinds = {"key_concepts", "domains", "facets"}
    return F.coalesce(F.size(name) == 0, F.lit(True)) if name in kinds else F.coalesce(F.col(name) == "", F.lit(True))


def enrichment_coverage(nodes: DataFrame) -> DataFrame:
    one = G.active(nodes).agg(F.count("*").alias("total"), n_if(~_blank("summary")).alias("summary"),
                              n_if(_blank("key_concepts")).alias("no_kc"), n_if(_blank("domains")).alias("no_dom"),
                              n_if(F.col("quality_score") > 0).alias("qs"))
    t = F.col("total")
    return as_rows(one.where("total > 0"), [
        scored("enrichment_coverage", "enrichment", F.col("summary") / t, O.VERIFY_THRESHOLDS["enrichment_coverage"]),
        scored("summary_null_pct", "enrichment", (t - F.col("summary")) / t, 0.5, False),
        scored("key_concepts_null_pct", "enrichment", F.col("no_kc") / t, 0.5, False),
        scored("domains_null_pct", "enrichment", F.col("no_dom") / t, 0.5, False),
        scored("quality_score_positive_pct", "enrichment", F.col("qs") / t, 0.3)])


def graph_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    act = F.col("status") == "active"
    one = edges.agg(n_if(act).alias("active_edges"), F.avg(F.when(act, F.col("strength"))).alias("avg_strength"))
    one = with_scalar(one, "total", G.active(nodes).agg(F.count("*")))
    one = with_scalar(one, "orphans", G.orphans(nodes, edges, "active").agg(F.count("*")))
    part = F.col("orphans") / F.greatest(F.col("total"), F.lit(1))
    ok = F.lit("PASS")
    return as_rows(one, [
        stated("edge_counts", "graph", F.col("active_edges"), ok),
        stated("orphan_nodes", "graph", F.col("orphans"), F.when(part < 0.15, "PASS").otherwise("WARN")),
        stated("avg_edge_strength", "graph", F.coalesce("avg_strength", F.lit(0.0)), ok),
        scored("connected_nodes_pct", "graph", (F.col("total") - F.col("orphans")) / F.greatest(F.col("total"), F.lit(1)), 0.85)])


def distribution(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(limit) if limit else out


def unused(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    names = df.sparkSession.createDataFrame([(k,) for k in sorted(set(known))], "value string")
    return names.join(df.select(F.col(column).alias("value")).distinct(), "value", "left_anti")


def promotion_checks(nodes: DataFrame) -> DataFrame:
    one = G.active(nodes).agg(n_if(F.col("type") == "Signal").alias("signals"),
                              n_if(F.col("promotion_candidate") == 1).alias("candidates"))
    falling = [(s, t) for s, ts in O.VALID_PROMOTIONS.items() for t in ts if O.PROMOTE_LAYER[t] < O.PROMOTE_LAYER[s]]
    closed = not any("system" in O.LAYER_PERMISSIONS[n]["write"] for n in (4, 5))
    return as_rows(one, [
        stated("signal_nodes_exist", "promotion", F.col("signals"), F.when(F.col("signals") > 0, "PASS").otherwise("WARN")),
        stated("valid_promotions_layer_check", "promotion", F.lit(len(falling)), F.lit("FAIL" if falling else "PASS")),
        stated("promotion_candidates", "promotion", F.col("candidates"), F.lit("PASS")),
        stated("l4_l5_access_control", "promotion", F.lit(int(closed)), F.lit("PASS" if closed else "WARN"))])


def layer_steps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that lead to a higher layer, counted per pair of layers."""
    a = nodes.select(F.col("id").alias("source_id"), F.col("layer").alias("source_layer"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("layer").alias("target_layer"))
    return (G.active(edges).join(a, "source_id").join(b, "target_id").where("source_layer < target_layer")
            .groupBy("source_layer", "target_layer").agg(F.count("*").alias("n")))


def set_difference(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """Names on one side only (both frames: name), each with the side."""
    return (declared.exceptAll(stored).select("name", F.lit("declared_only").alias("side"))
            .unionAll(stored.exceptAll(declared).select("name", F.lit("stored_only").alias("side"))))


def search_quality(ndcg5: Column, ndcg10: Column, hit_rate: Column) -> list[Column]:
    th = O.VERIFY_THRESHOLDS
    return [scored("ndcg@5", "search", ndcg5, th["ndcg@5"]), scored("ndcg@10", "search", ndcg10, th["ndcg@10"]),
            scored("hit_rate", "search", hit_rate, th["hit_rate"])]


def verification_rows(checks: DataFrame, run_id: str, as_of: str) -> DataFrame:
    return checks.select(F.lit(run_id).alias("run_id"), *CHECK_COLS, F.lit(as_of).cast("timestamp_ntz").alias("created_at"))


def recall_scenarios(counts: DataFrame, names: dict[int, str], coefficients: dict[str, tuple[float, float]],
                     repeated: DataFrame) -> DataFrame:
    """Scenario checks: every named request finds something, modes set their coefficient, repeated contents are refused.

    ``counts`` has (qid, n); ``coefficients`` maps a check name to (expected,
    actual); ``repeated`` has the outcome of inserting known contents again.
    """
    spark = counts.sparkSession
    asked = spark.createDataFrame(list(names.items()), "qid bigint, name string").join(counts, "qid", "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    blank = F.lit(None).cast("double").alias("threshold")
    found = asked.select("name", F.lit("recall").alias("category"), n.alias("score"), blank, F.when(n >= 1, "PASS").otherwise("FAIL").alias("status"))
    fixed = spark.createDataFrame([(k, "recall", float(got), None, "PASS" if got == want else "FAIL") for k, (want, got) in coefficients.items()],
                                  found.schema)
    refused = repeated.agg(n_if(F.col("outcome") == "inserted").cast("double").alias("score")).select(
        F.lit("duplicate_content_refused").alias("name"), F.lit("recall").alias("category"), "score", blank,
        F.when(F.col("score") == 0, "PASS").otherwise("WARN").alias("status"))
    return found.unionAll(fixed).unionAll(refused)


# --- reports ---------------------------------------------------------------

def health_snapshot(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """One row of counts; nodes and edges are each aggregated in a single pass."""
    act = F.col("status") == "active"
    unseen = act & (F.coalesce("visit_count", F.lit(0)) == 0)

    def aged(c: str) -> Column:
        return unseen & (F.col(c).isNull() | ~(F.col(c) > F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")))

    one = nodes.agg(
        n_if(act).alias("active_nodes"), n_if(F.col("status") == "archived").alias("archived_nodes"),
        n_if(act & (F.trim(F.coalesce("summary", F.lit(""))) != "")).alias("summary_present"),
        n_if(act & (F.size("key_concepts") > 0)).alias("key_concepts_present"),
        n_if(aged("created_at")).alias("stale_zero_visit_created_30d"), n_if(aged("updated_at")).alias("stale_zero_visit_updated_30d"))
    edge = edges.agg(n_if(act).alias("active_edges"),
                     n_if(act & F.trim(F.coalesce("description", F.lit(""))).isin("", "[]")).alias("blank_edge_desc"))
    live = G.live_edges(nodes, edges)
    one = with_scalar(one, "active_edges", edge.select("active_edges"))
    one = with_scalar(one, "blank_edge_desc", edge.select("blank_edge_desc"))
    one = with_scalar(one, "active_active_edges", live.agg(F.count("*")))
    one = one.withColumn("stale_active_edges", F.col("active_edges") - F.col("active_active_edges"))
    return with_scalar(one, "true_orphans", G.orphans(nodes, edges).agg(F.count("*")))


def spread_by_type(nodes: DataFrame, column: str) -> DataFrame:
    """Count, mean, extremes and interpolated percentiles per type; equal values are counted first."""
    v = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    folded = G.active(nodes).groupBy(F.coalesce("type", F.lit("NULL")).alias("type"), v.alias("v")).agg(F.count("*").alias("w"))
    at = weighted_percentiles(folded, "type", "v", "w", [0.5, 0.9]).groupBy("type").agg(
        *[F.round(F.max(F.when(F.col("p") == p, F.col("at"))), 6).alias(name) for p, name in ((0.5, "p50"), (0.9, "p90"))])
    return folded.groupBy("type").agg(
        F.sum("w").alias("n"), F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 6).alias("mean"),
        F.min("v").alias("least"), F.max("v").alias("most"),
        F.coalesce(F.sum(F.when(F.col("v") == 0, F.col("w"))), F.lit(0)).alias("zeros")).join(at, "type").select(
        "type", "n", "mean", "least", "most", "p50", "p90", "zeros")


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Population correlation; 0 without spread, null under two rows."""
    a, b = F.coalesce(F.col(x).cast("double"), F.lit(0.0)), F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    flat = (F.stddev_pop(a) == 0) | (F.stddev_pop(b) == 0)
    return df.agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.when(flat, 0.0).otherwise(F.round(F.corr(a, b), 6))).alias("correlation"))


def dead_fields(nodes: DataFrame) -> DataFrame:
    t = F.count("*")
    m, o = n_if(F.coalesce("maturity", F.lit(0.0)) == 0), n_if(F.coalesce("observation_count", F.lit(0)) == 0)
    return G.active(nodes).agg(t.alias("total_active"), m.alias("zero_maturity"), F.round(m / t * 100, 6).alias("zero_maturity_pct"),
                               o.alias("zero_observation"), F.round(o / t * 100, 6).alias("zero_observation_pct"))


def feedback_rates(feedback: DataFrame, as_of: str, days: int) -> DataFrame:
    rows = feedback.where(~older_than(as_of, F.col("created_at"), days))
    t = F.count("*")
    rate = lambda k: F.round(share(n_if(F.col("feedback_type") == k), t), 6)
    return rows.agg(t.alias("total"), rate("reject").alias("reject_rate"), rate("approve").alias("approve_rate"))


def retrieval_stats(logs: DataFrame, as_of: str, days: int) -> DataFrame:
    rows = logs.where(~older_than(as_of, F.col("created_at"), days))
    t = F.count("*")
    return rows.agg(t.alias("total_retrievals"), F.count_distinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("unique_sessions"),
                    F.round(share(n_if(F.col("cross_domain") == 1), t), 6).alias("cross_domain_rate"),
                    F.round(share(n_if(F.col("feedback_linked") == 1), t), 6).alias("feedback_linked_rate"))


def slot_averages(logs: DataFrame, as_of: str, days: int, sample: int = 500) -> DataFrame:
    """Mean of each slot over the latest ``sample`` well-formed rows; the sample size is part of the report."""
    rows = logs.where(~older_than(as_of, F.col("created_at"), days) & (F.col("slot_distribution") != "{}"))
    rows = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(sample)
    valid = rows.select(F.from_json("slot_distribution", "map<string,int>").alias("m")).where("m IS NOT NULL")
    total = valid.select("m", F.explode("m").alias("slot", "v")).groupBy("slot").agg(F.sum("v").alias("s"))
    n = valid.agg(F.count("*")).scalar()
    return total.select("slot", F.round(F.col("s") / n, 6).alias("slot_avg"))


def open_conflicts_by_source(conflicts: DataFrame) -> DataFrame:
    return conflicts.where("resolved = 0").groupBy(F.coalesce("conflicting_source_type", F.lit("null")).alias("source")).agg(
        F.count("*").alias("n"))


def stale_policies(rules: DataFrame, traits: DataFrame, as_of: str, days: int) -> DataFrame:
    """Compiled rules (name, trait_id, compiled_at) past their age whose trait no longer carries them."""
    old = rules.where(F.col("compiled_at").isNull() | older_than(as_of, F.col("compiled_at"), days))
    t = traits.select(F.col("id").alias("trait_id"), "status", "approval")
    reason = (F.when(F.col("compiled_at").isNull(), "no_compiled_at").when(F.col("trait_id").isNull(), "no_trait_link")
              .when(F.col("status").isNull(), "trait_missing")
              .when(F.col("status").isin("provisional", "archived") | F.col("approval").isin("pending", "rejected", "expired"),
                    F.concat(F.lit("trait status="), F.col("status"), F.lit(" approval="), F.col("approval"))))
    return old.join(t, "trait_id", "left").select("name", reason.alias("reason")).where("reason IS NOT NULL")


def daily_counts(nodes: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Active nodes per day, younger than ``days``."""
    young = F.col("created_at") > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAY")
    return (G.active(nodes).where(young).groupBy(F.to_date("created_at").cast("string").alias("day"))
            .agg(F.count("*").alias("n")))


def state_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    act = F.col("status") == "active"
    m, o = F.when(act, F.coalesce("maturity", F.lit(0.0))), F.when(act, F.coalesce("observation_count", F.lit(0)))
    one = nodes.agg(
        n_if(act).alias("active_nodes"), n_if(act & (F.col("type") == "Signal")).alias("signal"),
        n_if(act & (F.col("type") == "Correction")).alias("correction"),
        n_if(act & (F.col("epistemic_status") == "validated")).alias("validated"),
        n_if(act & (F.col("node_role") == "knowledge_core")).alias("knowledge_core"),
        F.round(F.avg(m), 6).alias("maturity_avg"), F.min(m).alias("maturity_min"), F.max(m).alias("maturity_max"),
        n_if(m == 0).alias("zero_maturity"), n_if(o > 0).alias("observation_nonzero"), F.max(o).alias("observation_max"))
    blank = F.trim(F.coalesce("direction", F.lit(""))) == ""
    e = edges.agg(n_if(act).alias("active_edges"), n_if(act & (F.col("relation") == "contradicts")).alias("contradicts"),
                  F.round(1 - share(n_if(act & blank), n_if(act)), 6).alias("direction_ratio"),
                  n_if(act & (F.coalesce("generation_method", F.lit("")) != "")
                       & ~F.col("generation_method").isin(O.GENERATION_METHODS)).alias("drift_edges"))
    row = e.first()
    for c in e.columns:
        one = one.withColumn(c, F.lit(row[c]))
    a = G.active(nodes).where("coalesce(project, '') <> ''")
    cross = (G.active(edges).join(a.select(F.col("id").alias("source_id"), F.col("project").alias("sp")), "source_id")
             .join(a.select(F.col("id").alias("target_id"), F.col("project").alias("tp")), "target_id").where("sp <> tp"))
    return with_scalar(one, "cross_domain", cross.agg(F.count("*")))


def filled_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    each = [F.struct(F.lit(c).alias("field"), n_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias("filled"),
                     F.count("*").alias("total")) for c in columns]
    one = df.agg(F.array(*each).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.field", "x.filled", "x.total", F.round(
        share(F.col("x.filled"), F.col("x.total")), 6).alias("ratio"))


def proven_knowledge(nodes: DataFrame) -> DataFrame:
    """Nodes that meet one of four criteria, under the first one met."""
    a = G.active(nodes)
    signals = a.where("type = 'Signal' AND visit_count >= 5").orderBy(
        F.desc("visit_count"), F.desc_nulls_last("quality_score"), "id").limit(15)
    fixes = a.where("type = 'Correction'").orderBy(F.desc("created_at"), "id").limit(10)
    parts = [(a.where("node_role = 'knowledge_core'"), "knowledge_core"),
             (a.where("epistemic_status = 'validated' AND quality_score >= 0.85"), "validated"),
             (signals, "high_signal"), (fixes, "correction")]
    out = None
    for i, (df, reason) in enumerate(parts):
        rows = df.select("id", F.struct(F.lit(i).alias("prio"), F.lit(reason).alias("reason")).alias("why"))
        out = rows if out is None else out.unionAll(rows)
    return out.groupBy("id").agg(F.min("why").alias("why")).select("id", "why.prio", "why.reason")


def memory_digest(nodes: DataFrame, as_of: str) -> DataFrame:
    """Sections of the memory page: core layer, best of the structural layer, decisions, questions, failures."""
    a = G.active(nodes)
    role = ~F.col("node_role").isin("external_noise", "work_item")
    fresh = ~F.col("epistemic_status").isin("outdated", "superseded")
    quality = F.coalesce("quality_score", O.lookup(O.UNENRICHED_QUALITY, F.col("layer"), 0.4))
    newest = [F.desc("created_at"), F.col("id")]
    best = [F.desc("q"), F.col("id")]
    decisions = a.where((F.col("type") == "Decision") & role & ~older_than(as_of, F.col("created_at"), 7))
    parts = [("core", a.where((F.col("layer") == 3) & role & fresh).withColumn("q", quality), None, best),
             ("structural", a.where((F.col("layer") == 2) & role & fresh).withColumn("q", quality), 15, best),
             ("decisions", decisions, 5, newest), ("questions", a.where((F.col("type") == "Question") & role), None, newest),
             ("failures", a.where("type = 'Failure'"), 3, newest)]
    out = None
    for name, df, limit, order in parts:
        rows = df.orderBy(*order).limit(limit) if limit else df
        rows = rows.select(F.lit(name).alias("section"), "id", F.substring("content", 1, 80).alias("preview"))
        out = rows if out is None else out.unionAll(rows)
    return out


def memory_audit(nodes: DataFrame) -> DataFrame:
    a = G.active(nodes)
    folded = a.select(F.posexplode(F.array(F.col("quality_score"), F.length("content").cast("double"))).alias("p", "v")).where(
        "v IS NOT NULL").groupBy("p", "v").agg(F.count("*").alias("w"))
    measure = F.when(F.col("p") == 0, "quality").otherwise("content_length")
    folded = folded.select(measure.alias("measure"), "v", "w")
    middle = weighted_percentiles(folded, "measure", "v", "w", [0.5]).select("measure", F.col("at").alias("median"))
    return folded.groupBy("measure").agg(
        F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 6).alias("mean")).join(middle, "measure")


def safety_net(nodes: DataFrame, as_of: str, hours: int = 2) -> DataFrame:
    recent = F.col("created_at") > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    return nodes.agg(n_if(recent).alias("saved_recently"),
                     n_if((F.col("type") == "Question") & (F.col("status") == "active")).alias("open_questions"))


def stability(similarities: DataFrame, column: str) -> DataFrame:
    """Mean, sample deviation and the lower bound two deviations below."""
    return similarities.agg(F.count("*").alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("stdev"),
                            F.round(F.avg(column) - 2 * F.stddev_samp(column), 6).alias("suggested"))
