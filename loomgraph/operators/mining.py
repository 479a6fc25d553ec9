"""Pattern mining over the graph and the retrieval log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators.scale import shared_item_sums, top_per_group


def co_retrieval(log: DataFrame, edges: DataFrame, min_count: int = 5, hub_percentile: int = 95,
                 exclude_queries: list[str] | None = None, archive_existing: bool = False,
                 legacy_stamp: str = "ts") -> DataFrame:
    """Edge upserts for node pairs that were retrieved together often enough.

    Sessions are recall ids, or (query, ``legacy_stamp``) where a row has none; the
    threshold applies to each kind before the counts are added. A pair of two
    hubs is skipped.
    """
    if exclude_queries:
        log = log.where(~F.col("query").isin(exclude_queries))
    named = log.where("recall_id IS NOT NULL").select(F.col("node_id").alias("n"), F.col("recall_id").alias("g"))
    legacy = log.where("recall_id IS NULL").select(F.col("node_id").alias("n"), F.concat_ws("|", "query", F.col(legacy_stamp).cast("string")).alias("g"))
    old = G.active(edges).where("relation = 'co_retrieved'")
    if archive_existing:
        old = old.where("coalesce(generation_method, '') <> 'co_retrieval'")
    old = old.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("id").alias("mark")).where("a < b")
    counts = shared_item_sums([named, legacy], min_count, G.hubs(edges, hub_percentile), old)
    boost = F.round(F.least(F.lit(0.1) * (F.col("shared") - min_count + 1), F.lit(0.5)), 6)
    return counts.select(
        F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("shared").alias("co_count"), boost.alias("boost"), F.col("mark").alias("edge_id"),
        F.when(F.col("mark").isNull(), "insert").otherwise("update").alias("action"))


def features(nodes: DataFrame) -> DataFrame:
    """(id, feature) from tags, concepts and domains."""
    def tagged(kind: str, words: Column) -> Column:
        return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit(kind), w))

    every = F.concat(tagged("tag:", T.csv_list(F.col("tags"))),
                     tagged("concept:", F.transform("key_concepts", F.lower)), tagged("domain:", F.col("domains")))
    return nodes.select("id", F.explode(F.array_distinct(every)).alias("feature"))


def overlap_components(members: DataFrame, feats: DataFrame) -> DataFrame:
    """Components of "shares a feature": each member is tied to the smallest member of each of its features."""
    first = feats.groupBy("feature").agg(F.min("id").alias("b"))
    ties = feats.join(first, "feature").select(F.col("id").alias("a"), "b").distinct()
    return members.select("id").join(G.components(ties), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))


def readiness(size: Column, quality: Column, domains: Column) -> Column:
    return (F.least(F.lit(1.0), size / 10) * 0.5 + quality * 0.3 + F.least(F.lit(1.0), domains / 3) * 0.2)


def recommend(ready: Column, bayes: Column, flagged: Column) -> Column:
    return (F.when((ready > 0.9) & (bayes > 0.6), "auto_promote")
            .when((bayes > 0.5) | (flagged >= 2) | (ready > 0.6), "user_review").otherwise("not_ready"))


def recommend_by_readiness(ready: Column) -> Column:
    return F.when(ready > 0.9, "auto_promote").when(ready > 0.6, "user_review").otherwise("not_ready")


def signal_clusters(nodes: DataFrame, total_queries: int, domain: str = "", min_size: int = 2,
                    top_k: int | None = 5) -> DataFrame:
    """Clusters of Signal nodes by shared features, with promotion readiness."""
    signals = G.active(nodes).where("type = 'Signal'")
    if domain:
        signals = signals.where(F.array_contains("domains", domain))
    comp = overlap_components(signals, features(signals))
    rows = signals.join(comp, "id")
    hits = F.lit(0)  # signals carry no own frequency
    bayes = (1 + hits) / (11 + F.greatest(F.lit(total_queries), hits))
    quality = F.coalesce(F.nullif("quality_score", F.lit(0.0)), F.lit(0.5))
    agg = rows.groupBy("component").agg(
        F.count("*").alias("size"), F.avg(quality).alias("quality"), F.avg(bayes).alias("bayesian_p"),
        F.sum(F.coalesce("promotion_candidate", F.lit(0))).alias("sprt_flagged"))
    doms = rows.select("component", F.explode("domains").alias("d")).distinct().groupBy("component").agg(
        F.count("*").alias("n_domains"), F.array_join(F.sort_array(F.collect_list("d")), ",").alias("domains"))
    theme = F.coalesce(F.nullif("summary", F.lit("")), F.substring("content", 1, 80))
    first = top_per_group(rows.select("component", "id", theme.alias("theme")), ["component"], [F.col("id")], 3)
    themes = first.groupBy("component").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "theme"))), lambda s: s["theme"]), "|").alias("themes"))
    ready = readiness(F.col("size"), F.col("quality"), F.coalesce("n_domains", F.lit(0)))
    out = (agg.where(F.col("size") >= min_size).join(doms, "component", "left").join(themes, "component")
           .withColumn("ready", ready))
    bayes_now = F.col("bayesian_p") if total_queries > 0 else F.lit(0.0)
    out = out.select("component", "size", F.round("ready", 6).alias("cluster_readiness"),
                     F.round(bayes_now, 9).alias("bayesian_p"), "sprt_flagged",
                     recommend(F.col("ready"), bayes_now, F.col("sprt_flagged")).alias("recommendation"),
                     "themes", F.coalesce("domains", F.lit("")).alias("domains"))
    return out if top_k is None else out.orderBy(F.desc("cluster_readiness"), "component").limit(top_k)


def cross_domain_clusters(nodes: DataFrame, column: str, per_cluster: int = 8) -> DataFrame:
    """Values of a list column that occur under two or more domains, with their first members."""
    live = G.active(nodes).where(F.size(column) > 0)
    values = live.select("id", "domains", F.explode(F.array_distinct(F.slice(column, 1, 3))).alias("value")).where(
        F.length("value") >= 2)
    spread = (values.select("value", F.explode("domains").alias("d")).distinct().groupBy("value")
              .agg(F.count("*").alias("n_domains")).where("n_domains >= 2"))
    size = values.groupBy("value").agg(F.count("*").alias("n_nodes")).where("n_nodes >= 2")
    first = top_per_group(values.select("value", "id"), ["value"], [F.col("id")], per_cluster)
    members = first.groupBy("value").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("members"))
    return spread.join(size, "value").join(members, "value").select(
        F.lit(column).alias("shared_field"), "value", "n_domains", "n_nodes", "members")


def random_cross_domain(nodes: DataFrame, seed: int = 11, per_domain: int = 4) -> DataFrame:
    """A few nodes of every domain, drawn by a seeded hash order."""
    rows = G.active(nodes).select("id", F.explode("domains").alias("domain"))
    return top_per_group(rows.withColumn("draw", F.xxhash64("id", F.lit(seed))), ["domain"],
                         [F.col("draw"), F.col("id")], per_domain).select("domain", "id")


def similar_pairs(nodes: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Node pairs with nearly equal concept sets and the same type or project.

    Equal nodes are first folded into profiles (concept set, type, project)
    with their row count, so a mass of copies gives one row instead of all its
    pairs; ``pairs`` says how many node pairs a row stands for. Sets that
    differ meet only through the rare tokens of a prefix filter.
    """
    floor = 1.0 - threshold
    concepts = F.array_sort(F.array_distinct(F.transform("key_concepts", lambda c: F.lower(F.trim(c)))))
    blank = F.lit("")
    rows = (G.active(nodes).select("id", F.coalesce("type", blank).alias("type"), F.coalesce("project", blank).alias("project"),
                                   concepts.alias("concepts")).where(F.size("concepts") > 0)
            .withColumn("sig", F.array_join("concepts", "\u001f")))
    profiles = rows.groupBy("sig", "type", "project").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    sets = rows.select("sig", "concepts").distinct()
    tokens = sets.select("sig", F.size("concepts").alias("len"), F.explode("concepts").alias("token"))
    rare = Window.partitionBy("sig").orderBy("freq", "token")  # one concept set is short
    prefix = (tokens.join(tokens.groupBy("token").agg(F.count("*").alias("freq")), "token")
              .withColumn("pos", F.row_number().over(rare))
              .where(F.col("pos") <= F.col("len") - F.ceil(F.col("len") * floor) + 1))
    left = prefix.select("token", F.col("sig").alias("sa"))
    right = prefix.select("token", F.col("sig").alias("sb"))
    cand = left.join(right, "token").where("sa < sb").select("sa", "sb").distinct()
    shared = F.size(F.array_intersect("ca", "cb")) / F.size(F.array_union("ca", "cb"))
    close = (cand.join(sets.select(F.col("sig").alias("sa"), F.col("concepts").alias("ca")), "sa")
             .join(sets.select(F.col("sig").alias("sb"), F.col("concepts").alias("cb")), "sb")
             .where(shared >= floor).select("sa", "sb"))
    both = close.unionAll(sets.select(F.col("sig").alias("sa"), F.col("sig").alias("sb")))

    def side(mark: str) -> DataFrame:
        return profiles.select(F.col("sig").alias(f"s{mark}"), F.col("type").alias(f"type_{mark}"),
                               F.col("project").alias(f"project_{mark}"), F.col("n").alias(f"n_{mark}"),
                               F.col("first_id").alias(f"id_{mark}"))

    meet = both.join(side("a"), "sa")
    b = side("b")
    same_type = meet.join(b.withColumn("type_a", F.col("type_b")), ["sb", "type_a"])
    same_project = meet.join(b.withColumn("project_a", F.col("project_b")), ["sb", "project_a"])
    hit = same_type.unionByName(same_project.where("type_a <> type_b"))
    own = (F.col("sa") == F.col("sb")) & (F.col("id_a") == F.col("id_b"))
    pairs = F.when(own, F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("bigint")
    return (hit.where((F.col("sa") != F.col("sb")) | (F.col("id_a") <= F.col("id_b")))
            .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), pairs.alias("pairs"))
            .where("pairs > 0"))


def domain_type_counts(nodes: DataFrame) -> DataFrame:
    fallback = F.coalesce(F.nullif("project", F.lit("")), F.lit("general"))
    domains = F.when(F.size(F.coalesce("domains", F.array().cast("array<string>"))) > 0, F.col("domains")).otherwise(F.array(fallback))
    return (G.active(nodes).select(F.explode(domains).alias("domain"), F.coalesce("type", F.lit("Unclassified")).alias("type"))
            .groupBy("domain", "type").agg(F.count("*").alias("n")))


def connected_nodes(pivots: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """First active neighbours of each pivot over edges of any status."""
    ends = G.endpoints(edges).select("nid", "nbr").join(pivots.select(F.col("id").alias("nid")), "nid", "left_semi")
    alive = G.active(nodes).select(F.col("id").alias("nbr"))
    once = ends.distinct().join(alive, "nbr", "left_semi")
    return top_per_group(once, ["nid"], [F.col("nbr")], limit, "pos").select(F.col("nid").alias("pivot"), "nbr", "pos")


def similar_nodes(pivots: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """Among the newest nodes of a pivot's type or project, those sharing most concepts.

    The newest 3·limit per type and per project are found once; pivots join those short lists.
    """
    pool = 3 * limit
    live = G.active(nodes).select(F.col("id").alias("nid"), "type", "project", "created_at",
                                  F.transform("key_concepts", lambda c: F.lower(F.trim(c))).alias("cc"))
    newest = [F.desc("created_at"), F.col("nid")]
    ask = pivots.select("id", "type", "project", F.transform("key_concepts", lambda c: F.lower(F.trim(c))).alias("pc"))
    cand = None
    for key in ("type", "project"):
        short = top_per_group(live, [key], newest, pool + 1).select(key, "nid", "created_at", "cc")
        hit = ask.join(short, key).where("nid <> id").select("id", "pc", "nid", "created_at", "cc")
        cand = hit if cand is None else cand.unionAll(hit)
    cand = cand.dropDuplicates(["id", "nid"])
    cand = top_per_group(cand, ["id"], newest, pool, "age").withColumn(
        "overlap", F.size(F.array_intersect("pc", "cc")))
    return top_per_group(cand, ["id"], [F.desc("overlap"), F.col("age")], limit, "pos").select(
        F.col("id").alias("pivot"), "nid", "overlap", "pos")


def diverse_neighbours(targets: DataFrame, nodes: DataFrame, limit: int = 12) -> DataFrame:
    """Four slots of three: same project and type, other layer, other project, most visited.

    Every slot is served from short per-group lists that still hold three rows
    after the target's own group is left out, so no target scans its group.
    """
    live = G.active(nodes).where("project <> ''").select(
        F.col("id").alias("nid"), F.col("type").alias("nt"), F.col("project").alias("np"), F.col("layer").alias("nl"),
        "created_at", F.coalesce("visit_count", F.lit(-1)).alias("v"))
    newest, visited = [F.desc("created_at"), F.col("nid")], [F.desc("v"), F.col("nid")]
    ask = targets.where("project <> ''").select("id", "type", "project", "layer")
    peers = top_per_group(live, ["np", "nt"], newest, 4)
    by_layer = top_per_group(top_per_group(live.where("nl IS NOT NULL"), ["np", "nl"], visited, 3).drop("rn"), ["np"], visited, 6)
    by_project = top_per_group(top_per_group(live, ["nt", "np"], visited, 3).drop("rn"), ["nt"], visited, 6)
    top = top_per_group(live, ["np"], visited, 4)
    slots = [
        ask.join(peers, (F.col("project") == F.col("np")) & (F.col("type") == F.col("nt"))),
        ask.join(by_layer, F.col("project") == F.col("np")).where("layer <> nl"),
        ask.join(by_project, F.col("type") == F.col("nt")).where("project <> np"),
        ask.join(top, F.col("project") == F.col("np")),
    ]
    out = None
    for i, slot in enumerate(slots, 1):
        three = top_per_group(slot.where("nid <> id").drop("rn"), ["id"], [F.desc("created_at") if i == 1 else F.desc("v"), F.col("nid")], 3, "p")
        part = three.select("id", "nid", F.lit(i).alias("slot"), "p")
        out = part if out is None else out.unionAll(part)
    once = top_per_group(out, ["id", "nid"], [F.col("slot")], 1)
    return top_per_group(once.drop("rn"), ["id"], [F.col("slot"), F.col("p")], limit, "pos").select("id", "nid", "slot", "pos")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Groups of active edges with the same ends, their class and the edge a merge keeps."""
    told = ~F.trim(F.coalesce("description", F.lit(""))).isin("", "[]")
    return (G.active(edges).groupBy("source_id", "target_id").agg(
        F.count("*").alias("edge_count"), (F.min("relation") != F.max("relation")).alias("mixed"),
        F.max(told).alias("told"),
        F.max_by("id", F.struct(F.coalesce("strength", F.lit(0.0)), -F.col("id"))).alias("keep_id"))
        .where("edge_count > 1")
        .select("source_id", "target_id", "edge_count",
                F.when(F.col("mixed"), "different_relations").when(F.col("told"), "same_relation_described")
                .otherwise("auto_merge").alias("kind"), "keep_id"))


def islands(nodes: DataFrame, edges: DataFrame, types: list[str], most: int = 1) -> DataFrame:
    """Knowledge nodes with at most ``most`` semantic edges."""
    semantic = G.active(edges).where(F.col("generation_method").isin("rule", "semantic_auto", "enrichment", "manual"))
    deg = G.endpoints(semantic).groupBy(F.col("nid").alias("id")).agg(F.count("*").alias("d"))
    return (G.active(nodes).where(F.col("type").isin(types)).join(deg, "id", "left")
            .where(F.coalesce("d", F.lit(0)) <= most).drop("d"))


def island_links(lonely: DataFrame, nodes: DataFrame, edges: DataFrame, near: DataFrame,
                 min_cosine: float = 0.55) -> DataFrame:
    """New edges from island nodes to near neighbours they are not joined to in either direction."""
    a = lonely.select(F.col("id").alias("source_id"), F.col("type").alias("st"), F.col("layer").alias("sl"), F.col("project").alias("sp"))
    b = G.active(nodes).select(F.col("id").alias("target_id"), F.col("type").alias("tt"), F.col("layer").alias("tl"), F.col("project").alias("tp"))
    known = G.endpoints(G.active(edges)).select(F.col("nid").alias("source_id"), F.col("nbr").alias("target_id")).distinct()
    cos = F.round(1 - F.col("distance"), 9)
    return (near.select(F.col("qid").alias("source_id"), F.col("id").alias("target_id"), cos.alias("cosine"))
            .where(F.col("cosine") >= min_cosine).join(a, "source_id").join(b, "target_id")
            .join(known, ["source_id", "target_id"], "left_anti")
            .select("source_id", "target_id", O.canonical_relation(O.infer_relation(
                *[F.col(c) for c in ("st", "sl", "tt", "tl", "sp", "tp")])).alias("relation"), "cosine"))


# Source type, missing relation, target types in order, least cosine.
CAUSAL_RULES = [
    ("Decision", "led_to", ["Pattern", "Insight"], 0.45),
    ("Decision", "resulted_in", ["Failure"], 0.45),
    ("Failure", "resolved_by", ["Decision", "Insight"], 0.45),
    ("Signal", "realized_as", ["Pattern", "Insight"], 0.50),
    ("Question", "resolved_by", ["Insight", "Decision"], 0.45),
]


def causal_links(nodes: DataFrame, edges: DataFrame, near: DataFrame, slack: float = 0.0) -> DataFrame:
    """Missing causal edges: per node and rule the first near enough target in type order.

    ``near`` holds the five nearest per target type (qid, id, distance, rank, hint);
    ``slack`` lowers every least cosine, for vectors of a weaker model.
    """
    rules = nodes.sparkSession.createDataFrame(
        [(s, rel, tt, i, m - slack) for s, rel, tts, m in CAUSAL_RULES for i, tt in enumerate(tts)],
        "st string, relation string, hint string, ord int, min_cos double")
    has = G.active(edges).select(F.col("source_id").alias("qid"), "relation").distinct()
    a = G.active(nodes).select(F.col("id").alias("qid"), F.col("type").alias("st"), F.col("project").alias("sp"))
    b = G.active(nodes).select("id", F.col("project").alias("tp"))
    broken = a.join(F.broadcast(rules), "st").join(has, ["qid", "relation"], "left_anti")
    cos = F.round(1 - F.col("distance"), 9)
    good = (broken.join(near, ["qid", "hint"]).join(b, "id").withColumn("cosine", cos)
            .where((F.col("cosine") >= F.col("min_cos"))
                   & ((F.col("sp") == F.col("tp")) | (F.col("cosine") >= F.col("min_cos") + 0.10))))
    one = top_per_group(good, ["qid", "relation"], [F.col("ord"), F.col("rank")], 1, "first")
    return one.select(F.col("qid").alias("source_id"), F.col("id").alias("target_id"), "relation", "cosine")
