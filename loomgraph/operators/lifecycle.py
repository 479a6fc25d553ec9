"""Learning and life-cycle transitions. Every function returns the changed rows or a new snapshot."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.functions.vector import cosine
from loomgraph.operators import graph as G
from loomgraph.operators.scale import top_per_group
from loomgraph.session import cut_lineage

SPRT_UPPER = math.log((1 - O.SPRT_BETA) / O.SPRT_ALPHA)
SPRT_LOWER = math.log(O.SPRT_BETA / (1 - O.SPRT_ALPHA))
SPRT_HIT = math.log(O.SPRT_P1 / O.SPRT_P0)
SPRT_MISS = math.log((1 - O.SPRT_P1) / (1 - O.SPRT_P0))

# Fixed values of the learning and decay rules.
LEARN_BOTH, LEARN_ONE, ONE_SIDED_LIMIT, STRENGTH_CAP = 0.015, 0.005, 50, 2.0
EDGE_DECAY, STRENGTH_FLOOR = 0.999, 0.05
PRUNE_STRENGTH, PRUNE_CONTEXTS, CONTEXT_HISTORY = 0.05, 2, 5
# End of the fixed values.


def now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def days_since(as_of: str, stamp: Column) -> Column:
    """Whole days from a zone-less stamp; a stamp in the future counts as today."""
    return F.greatest(F.extract(F.lit("DAY"), now(as_of) - stamp), F.lit(0))


def older_than(as_of: str, stamp: Column, days: int) -> Column:
    return stamp < now(as_of) - F.expr(f"INTERVAL {days} DAYS")


# --- sequential test -------------------------------------------------------

def sprt_verdict(history: Column, min_obs: int = O.SPRT_MIN_OBS) -> Column:
    """Fold a score list in order; the first bound crossed decides and later scores change nothing."""
    start = F.struct(F.lit(0.0).alias("llr"), F.lit("open").alias("verdict"))

    def step(acc, score):
        llr = acc["llr"] + F.when(score > 0.5, SPRT_HIT).otherwise(SPRT_MISS)
        crossed = F.when(llr >= SPRT_UPPER, "promote").when(llr <= SPRT_LOWER, "reject").otherwise("open")
        return F.struct(F.when(acc["verdict"] == "open", llr).otherwise(acc["llr"]).alias("llr"),
                        F.when(acc["verdict"] == "open", crossed).otherwise(acc["verdict"]).alias("verdict"))

    verdict = F.aggregate(history, start, step)["verdict"]
    return F.when(F.size(history) < min_obs, "open").otherwise(verdict)


def score_history(log: DataFrame, keep: int = O.SPRT_HISTORY, among: DataFrame | None = None) -> DataFrame:
    """Latest ``keep`` scores of each node in time order; a rank limit bounds every list before the shuffle.

    With ``among`` (id), a short list that should be held, only its nodes' scores leave the scan.
    """
    if among is not None:
        log = log.join(among.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    last = top_per_group(log.select("node_id", "ts", "id", F.round("score", 4).alias("score")),
                         ["node_id"], [F.desc("ts"), F.desc("id")], keep)
    ordered = F.sort_array(F.collect_list(F.struct("ts", "id", "score")))
    return last.groupBy(F.col("node_id").alias("id")).agg(F.transform(ordered, lambda s: s["score"]).alias("history"))


def sprt(nodes: DataFrame, log: DataFrame) -> DataFrame:
    signals = G.active(nodes).where("type = 'Signal'").select("id")
    return (score_history(log).join(signals, "id", "left_semi")
            .select("id", F.size("history").alias("n_obs"), sprt_verdict(F.col("history")).alias("verdict")))


def sprt_simulation(spark: SparkSession, p_true: float, n_sim: int = 10000, max_obs: int = 50, seed: int = 3,
                    min_obs: int = O.SPRT_MIN_OBS) -> DataFrame:
    """Monte-Carlo error rates: like the live test, but no bound counts before ``min_obs`` draws."""
    trial = spark.range(n_sim).withColumn("obs", F.explode(F.sequence(F.lit(1), F.lit(max_obs))))
    hit = trial.withColumn("llr", F.when(F.rand(seed) < p_true, SPRT_HIT).otherwise(SPRT_MISS))
    runs = hit.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("obs", "llr"))).alias("draws"))
    start = F.struct(F.lit(0.0).alias("llr"), F.lit("open").alias("verdict"), F.lit(0).alias("stop"))

    def step(acc, d):
        llr = acc["llr"] + d["llr"]
        due = d["obs"] >= min_obs
        v = F.when(due & (llr >= SPRT_UPPER), "promote").when(due & (llr <= SPRT_LOWER), "reject").otherwise("open")
        opened = acc["verdict"] == "open"
        return F.struct(llr.alias("llr"), F.when(opened, v).otherwise(acc["verdict"]).alias("verdict"),
                        F.when(opened, d["obs"]).otherwise(acc["stop"]).alias("stop"))

    done = runs.select(F.aggregate("draws", start, step).alias("r"))
    return done.groupBy(F.col("r.verdict").alias("verdict")).agg(
        F.count("*").alias("n"), (F.count("*") / n_sim).alias("rate"), F.avg("r.stop").alias("mean_obs"))


# --- reinforcement ---------------------------------------------------------

def hebbian_update(nodes: DataFrame, edges: DataFrame, results: DataFrame, as_of: str, query_text: str | dict[int, str] = "") -> DataFrame:
    """Edges touched by the results of a few requests (qid, id), strengthened.

    Both ends in one result list: +0.015. One end: +0.005 for the first 50 such
    edges of the request. Gains are positive, so summing them before the cap
    equals applying the requests one after another. With texts (one, or one per request) every request also leaves an entry in the
    edge's context log, which keeps the last five; of a larger batch only those are gathered. Edges are scanned once.
    """
    asked = results.select("qid", "id").distinct()
    pool = G.live_edges(nodes, G.edges_at(G.reasoning_edges(edges), results.select("id").distinct()))
    src = pool.join(asked.withColumnRenamed("id", "source_id"), "source_id").select("qid", "id", F.lit(1).alias("s"), F.lit(0).alias("t"))
    tgt = pool.join(asked.withColumnRenamed("id", "target_id"), "target_id").select("qid", "id", F.lit(0).alias("s"), F.lit(1).alias("t"))
    ends = src.unionAll(tgt).groupBy("qid", "id").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    both = ends.where("s = 1 AND t = 1").select("qid", "id", F.lit(LEARN_BOTH).alias("gain"))
    one = top_per_group(ends.where("s + t = 1"), ["qid"], [F.col("id")], ONE_SIDED_LIMIT).select(
        "qid", "id", F.lit(LEARN_ONE).alias("gain"))
    hits = both.unionAll(one)
    total = hits.groupBy("id").agg(F.sum("gain").alias("gain"), F.count("*").alias("hits"))
    description = F.col("description")
    if query_text:
        total = total.join(context_entries(hits, query_text, as_of), "id")
        old = F.coalesce(F.from_json("description", CONTEXT_LOG), F.array().cast(CONTEXT_LOG))
        added = F.concat(old, "entries")
        description = F.to_json(F.slice(added, F.greatest(F.size(added) - CONTEXT_HISTORY + 1, F.lit(1)), CONTEXT_HISTORY)).alias("description")
    base = F.coalesce(F.nullif("strength", F.lit(0.0)), F.lit(1.0))
    return (edges.join(total, "id")
            .select("id", F.round(F.least(base + F.col("gain"), F.lit(STRENGTH_CAP)), 6).alias("strength"),
                    (F.coalesce("frequency", F.lit(0)) + F.col("hits")).alias("frequency"),
                    now(as_of).alias("last_activated"), description))


CONTEXT_LOG = "array<struct<q:string,t:string>>"


def context_entries(hits: DataFrame, texts: str | dict[int, str], as_of: str) -> DataFrame:
    """(id, entries): for every edge the log entries of its last requests (qid, id), in order."""
    last = top_per_group(hits.select("qid", "id"), ["id"], [F.desc("qid")], CONTEXT_HISTORY)
    if isinstance(texts, str):
        told = last.withColumn("q", F.lit(texts))
    else:
        told = last.join(hits.sparkSession.createDataFrame(list(texts.items()), "qid bigint, q string"), "qid")
    ordered = F.sort_array(F.collect_list(F.struct("qid", "q")))
    return told.groupBy("id").agg(F.transform(ordered, lambda e: F.struct(F.substring(e["q"], 1, 80).alias("q"), F.lit(as_of).alias("t"))).alias("entries"))


def score_update(nodes: DataFrame, histories: DataFrame, results: DataFrame, keep: int = O.SPRT_HISTORY) -> DataFrame:
    """(id, score_history, promote) of the recalled signals: their scores, as shares of the request's best, appended to the history
    (id, history), the last ``keep`` of which stay, and what the sequential test says of them.

    Several requests are taken in the order of their numbers; of a larger batch only the last ``keep`` of a node are gathered.
    """
    best = results.groupBy("qid").agg(F.max("score").alias("best"))
    signals = G.active(nodes).where("type = 'Signal'").select("id")
    share = F.round(F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0), 4)
    rows = results.select("qid", "id", "score").join(best, "qid").join(signals, "id", "left_semi").select("qid", "id", share.alias("score"))
    last = top_per_group(rows, ["id"], [F.desc("qid")], keep)
    fresh = last.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("qid", "score"))), lambda e: e["score"]).alias("fresh"))
    both = F.concat(F.coalesce("history", F.array().cast("array<double>")), "fresh")
    kept = fresh.join(histories, "id", "left").select("id", F.slice(both, F.greatest(F.size(both) - keep + 1, F.lit(1)), keep).alias("history"))
    return kept.select("id", F.to_json("history").alias("score_history"), (sprt_verdict(F.col("history")) == "promote").alias("promote"))


def learn(nodes: DataFrame, edges: DataFrame, histories: DataFrame, results: DataFrame, texts: dict[int, str], as_of: str, session: str = "") -> dict[str, DataFrame]:
    """Everything that a batch of recalls writes back, one delta per table: strengthened edges with their context logs, counted visits,
    score histories with their verdicts, and the journal rows of every request.

    ``results`` (qid, id, rank, score, type, layer) is short and should be held, as every delta reads it.
    """
    journal = None
    for qid, text in texts.items():
        own = activation_rows(results.where(F.col("qid") == qid), text, session, as_of)
        journal = own if journal is None else journal.unionByName(own)
    return {"edges": hebbian_update(nodes, edges, results, as_of, texts), "visits": visit_update(nodes, results, as_of),
            "histories": score_update(nodes, histories, results), "journal": journal}


def visit_update(nodes: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    hits = results.groupBy("id").agg(F.count("*").alias("hits"))
    return nodes.join(hits, "id").select(
        "id", (F.coalesce("visit_count", F.lit(0)) + F.col("hits")).alias("visit_count"),
        (F.coalesce("observation_count", F.lit(0)) + F.col("hits")).alias("observation_count"),
        now(as_of).alias("last_accessed_at"))


def activation_rows(results: DataFrame, query: str, session: str, as_of: str) -> DataFrame:
    """Journal rows of one recall (qid, id, rank, score, type, layer): a summary, and a row for each of the first ten nodes."""
    asked = F.lit(query[:200])
    score = F.round("score", 4)
    top = results.where("rank <= 10")
    first = F.sort_array(F.collect_list(F.struct("rank", "id", score.alias("s"))))
    sums = top.groupBy("qid").agg(first.alias("first")).join(results.groupBy("qid").agg(F.count("*").alias("n")), "qid")
    recall = sums.select(
        "qid", F.lit("recall").alias("action_type"), F.lit("claude").alias("actor"), F.lit(None).cast("bigint").alias("target_id"),
        F.to_json(F.struct(asked.alias("query"), F.col("n").alias("result_count"), F.transform("first", lambda x: x["id"]).alias("top_ids"))).alias("params"),
        F.to_json(F.struct(F.col("n").alias("count"), F.transform(F.slice("first", 1, 5), lambda x: x["s"]).alias("top_scores"))).alias("result"))
    node = F.to_json(F.struct(asked.alias("context_query"), score.alias("activation_score"), F.col("rank").alias("activation_rank"), F.lit("hybrid").alias("channel"),
                              F.coalesce("type", F.lit("")).alias("node_type"), F.col("layer").alias("node_layer")), {"ignoreNullFields": "false"})
    each = top.select("qid", F.lit("node_activated").alias("action_type"), F.lit("system").alias("actor"), F.col("id").alias("target_id"),
                      node.alias("params"), F.lit(None).cast("string").alias("result"))
    return recall.unionAll(each).withColumn("session_id", F.lit(session)).withColumn("created_at", now(as_of))


def edge_contribution(edges: DataFrame, seeds: DataFrame, top: DataFrame) -> DataFrame:
    """+1 on active edges between a seed and one of the first five results of the same request."""
    s, r = seeds.select("qid", "id"), top.select("qid", "id")
    fwd = G.active(edges).join(s.withColumnRenamed("id", "source_id"), "source_id").join(r.withColumnRenamed("id", "target_id"), ["qid", "target_id"])
    back = G.active(edges).join(s.withColumnRenamed("id", "target_id"), "target_id").join(r.withColumnRenamed("id", "source_id"), ["qid", "source_id"])
    hit = fwd.select("qid", "id").unionAll(back.select("qid", "id")).distinct().groupBy("id").agg(F.count("*").alias("hits"))
    return edges.join(hit, "id").select("id", (F.coalesce("frequency", F.lit(0)) + F.col("hits")).alias("frequency"))


# --- decay and pruning -----------------------------------------------------

def decay_edges(edges: DataFrame, as_of: str) -> DataFrame:
    """One application of the time decay; ``outcome`` tells what happened to the edge."""
    s = F.coalesce("strength", F.lit(0.0))
    days = days_since(as_of, F.coalesce("last_activated", "created_at"))
    raw = s * F.pow(F.lit(EDGE_DECAY), days)
    low = raw < STRENGTH_FLOOR
    outcome = (F.when(days.isNull() | (days == 0), "unchanged").when(low & (s <= STRENGTH_FLOOR), "at_floor")
               .when(low, "floored").when(F.abs(raw - s) < 1e-9, "unchanged").otherwise("decayed"))
    out = edges.where("status <> 'deleted'").withColumn("outcome", outcome).withColumn("raw", raw)
    new = F.when(F.col("outcome") == "decayed", F.round("raw", 6)).when(
        F.col("outcome") == "floored", STRENGTH_FLOOR).otherwise(F.col("strength"))
    return out.select("id", "strength", new.alias("new_strength"), "outcome")


def distinct_contexts(description: Column) -> Column:
    log = F.from_json(description, "array<struct<q:string>>")
    asked = F.transform(F.filter(log, lambda e: e.isNotNull()), lambda e: F.coalesce(e["q"], F.lit("")))
    return F.coalesce(F.size(F.array_distinct(asked)), F.lit(0))


def _prune_base(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    act = G.active(edges)
    deg = G.degree(act)
    strong = F.coalesce("strength", F.lit(0.0)) + F.coalesce("frequency", F.lit(0)) * 0.1 > PRUNE_STRENGTH
    weak = act.where(~strong & (distinct_contexts(F.col("description")) < PRUNE_CONTEXTS))
    src = nodes.select(F.col("id").alias("source_id"), (
        (F.coalesce("tier", F.lit(2)) == 0) | (F.coalesce("layer", F.lit(0)) >= 2)).alias("kept_source"))
    return (weak.select("id", "source_id", "target_id").join(src, "source_id", "left")
            .join(deg.select(F.col("id").alias("source_id"), F.col("degree").alias("src_deg")), "source_id")
            .join(deg.select(F.col("id").alias("target_id"), F.col("degree").alias("tgt_deg")), "target_id")
            .withColumn("kept_source", F.coalesce("kept_source", F.lit(False))))


def edge_pruning(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Decision per weak active edge against the present degrees; all other active edges are kept."""
    guard = (F.col("src_deg") <= 1) | (F.col("tgt_deg") <= 1)
    return _prune_base(nodes, edges).select("id", F.when(guard, "guarded").when(
        F.col("kept_source"), "archive").otherwise("delete").alias("decision"))


def edge_pruning_applied(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same decisions taken in id order, each deletion lowering the degrees the later ones see.

    A deletion can only be stopped at a node all of whose edges are to be
    deleted, and there only at the last of them; it is stopped iff no earlier
    edge of that node was. So just those last edges are resolved, in rounds,
    each waiting for earlier last edges at the same node. No ordered fold.
    """
    base = cut_lineage(_prune_base(nodes, edges))
    doomed = base.where("NOT kept_source").withColumn("loop", F.col("source_id") == F.col("target_id"))
    at = doomed.select("id", "loop", F.explode(F.array(
        F.struct(F.col("source_id").alias("n"), F.col("src_deg").alias("deg")),
        F.struct(F.col("target_id").alias("n"), F.col("tgt_deg").alias("deg")))).alias("e")).select("id", "loop", "e.n", "e.deg")
    tight = at.groupBy("n").agg(F.count("*").alias("c"), F.max("deg").alias("deg"), F.max_by("loop", "id").alias("loop"),
                                F.max("id").alias("last_id")).where("c = deg AND NOT loop").select("n", "last_id")
    last = cut_lineage(tight)
    # edges that are the last of some tight node, seen at every tight node they touch
    risky = last.select(F.col("last_id").alias("id")).distinct()
    seen_at = cut_lineage(at.where("NOT loop").select("id", "n").join(risky, "id", "left_semi").join(last, "n"))
    kept = edges.sparkSession.createDataFrame([], "id bigint, kept boolean")
    open_ = cut_lineage(risky)
    while not open_.isEmpty():  # the smallest open edge never waits, so every round settles one
        state = seen_at.join(kept, "id", "left")
        # per tight node: is an earlier edge still open, was an earlier one kept
        per_node = state.where("id < last_id").groupBy("n", "last_id").agg(
            F.max(F.col("kept").isNull()).alias("waiting"), F.max(F.coalesce("kept", F.lit(False))).alias("relieved"))
        mine = last.join(per_node, ["n", "last_id"], "left").select(
            F.col("last_id").alias("id"), F.coalesce("waiting", F.lit(False)).alias("waiting"),
            F.coalesce("relieved", F.lit(False)).alias("relieved"))
        ready = (mine.join(open_, "id", "left_semi").groupBy("id")
                 .agg(F.max("waiting").alias("waiting"), F.min("relieved").alias("relieved"))
                 .where("NOT waiting").select("id", (~F.col("relieved")).alias("kept")))
        kept = cut_lineage(kept.unionAll(ready))
        open_ = cut_lineage(open_.join(kept, "id", "left_anti"))
    gone = doomed.join(kept.where("kept").select("id"), "id", "left_anti")
    lost = gone.select("id", F.explode(F.array("source_id", "target_id")).alias("n"))
    # a kept-source edge is guarded if every other edge of one of its ends went before it
    arch = base.where("kept_source").select("id", F.explode(F.array(
        F.struct(F.col("source_id").alias("n"), F.col("src_deg").alias("deg")),
        F.struct(F.col("target_id").alias("n"), F.col("tgt_deg").alias("deg")))).alias("e")).select("id", "e.n", "e.deg")
    near = arch.where("deg <= 1").select("id")
    all_but_one = lost.groupBy("n").agg(F.count("*").alias("gone"), F.max("id").alias("last_gone"))
    bare = arch.join(all_but_one, "n").where("gone = deg - 1 AND last_gone < id").select("id")
    guarded_arch = near.unionAll(bare).distinct().withColumn("g", F.lit(True))
    return (base.select("id", "kept_source").join(kept, "id", "left").join(guarded_arch, "id", "left")
            .select("id", F.when(F.coalesce("kept", F.lit(False)) | F.coalesce("g", F.lit(False)), "guarded")
                    .when(F.col("kept_source"), "archive").otherwise("delete").alias("decision")))


def permitted(layer: Column, operation: str, actor: str, is_hub: Column | None = None) -> Column:
    """Layer permission of one actor; the ten strongest hubs are closed to write and delete."""
    base = actor.split(":")[0]
    level = F.least(F.coalesce(layer, F.lit(0)), F.lit(5)).cast("int")
    ok = {n: bool({"all", base, actor} & set(ops.get(operation, ["owner"]))) for n, ops in O.LAYER_PERMISSIONS.items()}
    allowed = O.lookup(ok, level, False)
    if is_hub is not None and operation in ("write", "delete"):
        allowed = allowed & ~F.coalesce(is_hub, F.lit(False))
    return allowed


def top_hubs(snapshots: DataFrame, n: int = 10) -> DataFrame:
    latest = snapshots.where(F.col("snapshot_date") == snapshots.agg(F.max("snapshot_date")).scalar())
    return latest.orderBy(F.desc("ihs_score"), "node_id").limit(n).select(F.col("node_id").alias("id"))


def node_prune_candidates(nodes: DataFrame, edges: DataFrame, as_of: str, protected: DataFrame | None = None,
                          actor: str = "system:pruning", limit: int | None = 100) -> DataFrame:
    """Low-value inactive nodes with fewer than three edges, and whether the actor may mark them."""
    old = F.col("updated_at").isNull() | older_than(as_of, F.col("updated_at"), 90)
    poor = (G.active(nodes).where((F.coalesce("quality_score", F.lit(0.0)) < 0.3) & (F.coalesce("observation_count", F.lit(0)) < 2)
                                  & old & F.col("layer").isin(0, 1)))
    deg = G.endpoints(edges).groupBy(F.col("nid").alias("id")).agg(F.count("*").alias("edge_count"))
    out = (poor.join(deg, "id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0).cast("bigint")))
           .where("edge_count < 3"))
    if protected is not None:
        out = out.join(protected.select("id", F.lit(True).alias("hub")), "id", "left")
    else:
        out = out.withColumn("hub", F.lit(False))
    out = out.select("id", "edge_count", F.coalesce("quality_score", F.lit(0.0)).alias("quality"),
                     permitted(F.col("layer"), "write", actor, F.col("hub")).alias("allowed"))
    return out.orderBy("quality", "id").limit(limit) if limit else out


def expired_candidates(nodes: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return nodes.where("status = 'pruning_candidate'").where(older_than(as_of, F.col("updated_at"), days)).select("id")


def dead_edges(edges: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    unused = older_than(as_of, F.coalesce("last_activated", "created_at"), days)
    return edges.where(unused & (F.col("frequency") == 0) & (F.col("strength") < 0.2)).select("id")


# --- growth and promotion --------------------------------------------------

def growth_score(quality: Column, edge_count: Column, visits: Column, projects: Column, created: Column,
                 contradicted: Column, as_of: str) -> Column:
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - days_since(as_of, created) / 90), F.lit(0.5))
    total = (F.coalesce(quality, F.lit(0.5)) * 0.3 + F.least(F.lit(1.0), edge_count / 10) * 0.2
             + F.least(F.lit(1.0), F.coalesce(visits, F.lit(0)) / 10) * 0.2
             + F.least(F.lit(1.0), projects / 3) * 0.2 + recency * 0.1 - F.when(contradicted, 0.2).otherwise(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def neighbourhood(nodes: DataFrame, edges: DataFrame, active_projects: bool = True) -> DataFrame:
    """Per node: edge count, distinct neighbour projects, any contradiction.

    Neighbour projects are made distinct before they are counted, so a hub is
    combined map-side instead of being gathered.
    """
    ends = G.endpoints(edges, "relation")
    base = ends.groupBy(F.col("nid").alias("id")).agg(
        F.count("*").alias("edge_count"), F.max(F.col("relation") == "contradicts").alias("contra"))
    src = (G.active(nodes) if active_projects else nodes).where("coalesce(project, '') <> ''")
    proj = (ends.select("nid", "nbr").join(src.select(F.col("id").alias("nbr"), "project"), "nbr")
            .select("nid", "project").distinct().groupBy(F.col("nid").alias("id")).agg(F.count("*").alias("n_projects")))
    return base.join(proj, "id", "left").withColumn("n_projects", F.coalesce("n_projects", F.lit(0).cast("bigint")))


def with_neighbourhood(rows: DataFrame, around: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return (rows.join(around, "id", "left").withColumn("edge_count", F.coalesce("edge_count", zero))
            .withColumn("n_projects", F.coalesce("n_projects", zero)).withColumn("contra", F.coalesce("contra", F.lit(False))))


def _growth_of_row(as_of: str) -> Column:
    return growth_score(F.col("quality_score"), F.col("edge_count"), F.col("visit_count"), F.col("n_projects"),
                        F.col("created_at"), F.col("contra"), as_of)


def batch_growth(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """New maturity of all active nodes. A self-loop counts for both of its ends."""
    act = G.active(edges)
    loops = act.where("source_id = target_id").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("loops"))
    around = neighbourhood(nodes, act).join(loops, "id", "left").withColumn(
        "edge_count", F.col("edge_count") + F.coalesce("loops", F.lit(0))).drop("loops")
    rows = with_neighbourhood(G.active(nodes).select("id", "quality_score", "visit_count", "created_at"), around)
    return rows.select("id", F.round(_growth_of_row(as_of), 6).alias("maturity"))


def becoming(nodes: DataFrame, edges: DataFrame, as_of: str, domain: str = "", top_k: int | None = 10) -> DataFrame:
    rows = G.active(nodes).where(F.col("type").isin(list(O.VALID_PROMOTIONS)))
    if domain:
        rows = rows.where(F.array_contains("domains", domain))
    out = with_neighbourhood(rows, neighbourhood(nodes, G.live_edges(nodes, edges)))
    targets = O.lookup({t: ",".join(v) for t, v in O.VALID_PROMOTIONS.items()}, F.col("type"))
    out = out.select("id", "type", "layer", "edge_count", F.coalesce("visit_count", F.lit(0)).alias("visit_count"),
                     F.round(F.least(F.lit(1.0), F.col("n_projects") / 3), 6).alias("diversity"),
                     F.round(_growth_of_row(as_of), 6).alias("growth_score"), targets.alias("can_promote_to"))
    return out if top_k is None else out.orderBy(F.desc("growth_score"), "id").limit(top_k)


def swr_readiness(nodes: DataFrame, edges: DataFrame, log: DataFrame) -> DataFrame:
    """Share of vector hits in the log and project spread of the neighbours, per node with either."""
    vec, fts = F.contains("sources", F.lit('"vector"')), F.contains("sources", F.lit('"fts5"'))
    hits = log.where("sources IS NOT NULL AND sources <> '[]'").groupBy(F.col("node_id").alias("id")).agg(
        F.sum(vec.cast("int")).alias("v"), F.sum(fts.cast("int")).alias("f"))
    around = neighbourhood(nodes, G.active(edges), active_projects=False)
    rows = with_neighbourhood(nodes.select("id"), around).join(hits, "id", "left")
    total = F.coalesce(F.col("v") + F.col("f"), F.lit(0))
    vec_ratio = F.when(total > 0, F.col("v") / total).otherwise(0.5)
    cross = F.when(F.col("edge_count") > 0, F.col("n_projects") / F.col("edge_count")).otherwise(0.0)
    score = 0.6 * vec_ratio + 0.4 * cross
    return rows.select("id", F.round(score, 6).alias("readiness"), (score > O.SWR_THRESHOLD).alias("swr_ok"))


def promotion_candidates(nodes: DataFrame, edges: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """Nodes that pass the visit, edge, project and growth gates, with the advisory readiness."""
    pool = G.active(nodes).where(F.col("type").isin(list(O.VALID_PROMOTIONS)) & (F.coalesce("visit_count", F.lit(0)) >= 3)
                                 & (F.col("epistemic_status") != "validated"))
    rows = with_neighbourhood(pool, neighbourhood(nodes, G.active(edges), active_projects=False))
    least = F.when(F.col("visit_count") >= 10, 2).otherwise(3)
    rows = rows.withColumn("quality_score", F.coalesce("quality_score", F.lit(0.0)))
    rows = rows.where((F.col("edge_count") >= least) & ((F.col("edge_count") >= 5) | (F.col("n_projects") >= 1)))
    rows = rows.withColumn("growth", _growth_of_row(as_of)).where("growth >= 0.5")
    target = O.lookup({t: v[0] for t, v in O.VALID_PROMOTIONS.items()}, F.col("type"))
    return rows.join(swr_readiness(nodes, edges, log), "id").select(
        "id", "type", target.alias("target"), "visit_count", F.round("growth", 6).alias("growth_score"), "edge_count",
        "n_projects", "swr_ok", "readiness")


def mdl_gate(vectors: DataFrame, groups: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Mean pairwise cosine of each group (group_id, id) from the sum of its unit vectors.

    For unit vectors the squared norm of the sum is n plus twice the pair sum,
    so one aggregate per dimension replaces all pairs. Fewer than two vectors pass.
    """
    unit = vectors.join(groups, "id").withColumn("norm", F.sqrt(F.aggregate(
        F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)))
    dims = unit.select("group_id", F.posexplode("embedding").alias("dim", "x"), "norm").withColumn(
        "u", F.col("x").cast("double") / (F.col("norm") + 1e-9))
    part = dims.groupBy("group_id", "dim").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("sq"),
                                               F.count("*").alias("n"))
    agg = part.groupBy("group_id").agg(F.sum(F.col("s") * F.col("s")).alias("total"), F.sum("sq").alias("own"), F.max("n").alias("n"))
    mean = (F.col("total") - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    sim = F.when(F.col("n") >= 2, F.round(mean, 6))
    return agg.select("group_id", F.col("n").alias("members"), sim.alias("avg_similarity"),
                      F.coalesce(sim > threshold, F.lit(True)).alias("passed"))


def promote(nodes: DataFrame, chosen: DataFrame, as_of: str) -> DataFrame:
    """State of promoted nodes: new type, layer and role; what they were goes to the history text."""
    new = nodes.join(chosen.select("id", F.col("target").alias("new_type")), "id")
    layer = O.lookup(O.PROMOTE_LAYER, F.col("new_type"))
    return new.select("id", F.col("type").alias("old_type"), "new_type", layer.alias("new_layer"),
                      F.lit("knowledge_core").alias("node_role"), F.lit("validated").alias("epistemic_status"),
                      F.to_json(F.struct(F.col("type").alias("from"), F.col("new_type").alias("to"),
                                         F.lit(as_of).alias("at"))).alias("history"))


def realized_edges(chosen: DataFrame, related: DataFrame) -> DataFrame:
    """Edges from the related nodes of a promotion (target_id, id) to the promoted node."""
    return related.join(chosen.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(
        F.col("id").alias("source_id"), "target_id", F.lit("realized_as").alias("relation"), F.lit(1.0).alias("strength"))


def assign_tiers(nodes: DataFrame) -> DataFrame:
    """Tier after the three rules in order; a stale 0 or 1 stays, as no rule clears it."""
    new = (F.when((F.col("layer") == 2) & (F.col("quality_score") >= 0.8), 1).when(F.col("layer") >= 3, 0)
           .when(F.col("tier").isin(0, 1), F.col("tier")).otherwise(2))
    return G.active(nodes).select("id", "tier", new.alias("new_tier"))


# Confidence lost per kind of flag.
FLAG_PENALTY = {"inaccurate": 0.2, "outdated": 0.15, "irrelevant": 0.1}


def flag_nodes(nodes: DataFrame, flags: DataFrame) -> DataFrame:
    """Lowered confidence and new status of the active nodes flagged (id, flag)."""
    held_conf = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5))
    loss = O.lookup(FLAG_PENALTY, F.col("flag"), 0.1)
    return G.active(nodes).join(flags, "id").select(
        "id", F.round(F.greatest(F.lit(0.1), held_conf - loss), 6).alias("confidence"),
        F.when(F.col("flag") == "inaccurate", "flagged").otherwise(F.col("flag")).alias("epistemic_status"))


def flag_corrections(nodes: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The correction nodes of (id, flag, reason), and their feedback rows; each contradicts its node at 0.9."""
    hit = G.active(nodes).select("id", "project").join(flags, "id")
    text = F.concat(F.lit("[Correction] Node #"), F.col("id").cast("string"), F.lit(" flagged as "), F.col("flag"),
                    F.lit(": "), F.col("reason"))
    node = hit.select(F.col("id").alias("contradicts_id"), text.alias("content"), "project", F.lit("Correction").alias("type"),
                      F.lit("correction").alias("node_role"), F.lit("validated").alias("epistemic_status"),
                      F.lit(0.8).alias("confidence"), F.lit(0.9).alias("edge_strength"))
    return node, hit.select(F.lit("node").alias("target_type"), F.col("id").alias("target_id"),
                            F.col("flag").alias("feedback_type"), F.col("reason").alias("content"))


def semantic_drift(old: DataFrame, new: DataFrame, threshold: float = O.DRIFT_THRESHOLD) -> DataFrame:
    """Nodes whose new vector left the old one; the old vector is to be kept for them."""
    both = old.select("id", F.col("embedding").alias("a")).join(new.select("id", F.col("embedding").alias("b")), "id")
    sim = F.round(cosine(F.col("a"), F.col("b")), 6)
    return both.select("id", sim.alias("similarity"), (sim < threshold).alias("drifted"))


def summary_medians(nodes: DataFrame, sample: int = 100, least: int = O.SUMMARY_LENGTH_MIN_SAMPLE) -> DataFrame:
    """Median summary length of the latest ``sample`` summaries per type."""
    rows = nodes.where("status = 'active' AND coalesce(summary, '') <> ''").select(
        "type", F.length("summary").alias("len"), F.coalesce("updated_at", "created_at").alias("at"), "id")
    last = top_per_group(rows, ["type"], [F.desc("at"), F.desc("id")], sample)
    return last.groupBy("type").agg(F.count("*").alias("sample_size"), F.median("len").alias("median_len")).where(
        F.col("sample_size") >= least)


def summary_anomalies(nodes: DataFrame) -> DataFrame:
    med = summary_medians(nodes)
    rows = nodes.where("coalesce(summary, '') <> ''").select("id", "type", F.length("summary").alias("len"))
    return rows.join(med, "type").where(F.col("len") > F.col("median_len") * O.SUMMARY_LENGTH_MULTIPLIER).select(
        "id", "type", "len", "median_len")


def sync_catalog(declared: DataFrame, stored: DataFrame, reactivate: bool) -> DataFrame:
    """Insert, update or deprecate catalog rows (name, description); relations may be revived, types not."""
    d = declared.select("name", F.col("description").alias("new_description"))
    both = d.join(stored.select("name", "description", "status"), "name", "full_outer")
    action = (F.when(F.col("status").isNull(), "insert")
              .when(F.col("new_description").isNull() & (F.col("status") == "active"), "deprecate")
              .when(F.col("new_description").isNull(), "none")
              .when((F.col("status") == "deprecated") & F.lit(reactivate), "reactivate")
              .when(~F.col("new_description").eqNullSafe(F.col("description")), "update").otherwise("none"))
    return both.select("name", action.alias("action"))
