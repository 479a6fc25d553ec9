"""Graph operators on the (nodes, edges) frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.operators.scale import best_row, held, top_per_group
from loomgraph.session import cut_lineage


#: Rows of a request's lists up to which they are kept as local relations.
HELD = 100_000


def active(df: DataFrame) -> DataFrame:
    return df.where("status = 'active'")


def endpoints(edges: DataFrame, *cols: str) -> DataFrame:
    """One row per (edge, end): the node ``nid``, its neighbour ``nbr`` and ``out`` direction.

    Replaces every ``source = x OR target = x`` join by an equi-join. A self-loop gives one row. The edges are read once.
    """
    def end(nid: str, nbr: str, out: bool) -> Column:
        return F.struct(F.col("id").alias("edge_id"), F.col(nid).alias("nid"), F.col(nbr).alias("nbr"), F.lit(out).alias("out"), *cols)

    fwd, back = end("source_id", "target_id", True), end("target_id", "source_id", False)
    return edges.select(F.inline(F.when(F.col("source_id") != F.col("target_id"), F.array(fwd, back)).otherwise(F.array(fwd))))


def touched(edges: DataFrame) -> DataFrame:
    """Distinct ids that end some edge."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def live_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active edges between two active nodes."""
    ids = active(nodes).select("id")
    return (active(edges)
            .join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
            .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"))


def edges_at(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Active edges that end in one of a list of ids (results or seeds of requests).

    A list of a checked size becomes a local relation, which Spark sends to the edges; a longer one is joined.
    """
    few = held(ids.select("id").distinct(), HELD).withColumn("_hit", F.lit(True))
    act = active(edges)
    s = act.join(few.withColumnRenamed("id", "source_id").withColumnRenamed("_hit", "_s"), "source_id", "left")
    both = s.join(few.withColumnRenamed("id", "target_id").withColumnRenamed("_hit", "_t"), "target_id", "left")
    return both.where("_s OR _t").select(*edges.columns)


def degree(edges: DataFrame) -> DataFrame:
    """Both ends counted, so a self-loop adds two."""
    return (edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
            .groupBy("id").agg(F.count("*").alias("degree")))


def hubs(edges: DataFrame, percentile: int = 95) -> DataFrame:
    """Nodes at or above the degree found at position ``int(n * (1 - p/100))`` of the descending list.

    The position is located on the degree histogram, whose rows are distinct
    degrees, not nodes; no node list is sorted in one task.
    """
    deg = degree(active(edges))
    hist = deg.groupBy("degree").agg(F.count("*").alias("nodes"))
    upto = F.sum("nodes").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("nodes").over(Window.partitionBy())
    ranked = hist.withColumn("upto", upto).withColumn(
        "pos", F.floor(total * F.lit(1 - percentile / 100)).cast("bigint"))
    cut = ranked.where("upto > pos").agg(F.max("degree").alias("cut"))
    return deg.where(F.col("degree") >= cut.scalar())


def in_degree(nodes: DataFrame, edges: DataFrame, top_n: int) -> DataFrame:
    """Hub score: incoming edges of any status; nodes without any keep 0."""
    incoming = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("ihs_score"))
    scored = (active(nodes).select("id", "type", "layer").join(incoming, "id", "left")
              .withColumn("ihs_score", F.coalesce("ihs_score", F.lit(0).cast("bigint"))))
    return scored.orderBy(F.desc("ihs_score"), "id").limit(top_n)


def hub_risk(score: Column) -> Column:
    return F.when(score > 50, "HIGH").when(score > 20, "MEDIUM").otherwise("LOW")


def orphans(nodes: DataFrame, edges: DataFrame, rule: str = "active_both") -> DataFrame:
    """Active nodes no edge ends in: over any edge row, over active edges, or over fully active ones."""
    pool = {"any": lambda: edges, "active": lambda: active(edges),
            "active_both": lambda: live_edges(nodes, edges)}[rule]()
    return active(nodes).join(touched(pool), "id", "left_anti")


def single_edge_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active nodes with exactly one active edge."""
    deg = endpoints(active(edges)).groupBy(F.col("nid").alias("id")).agg(F.count("*").alias("edge_count"))
    return active(nodes).join(deg.where("edge_count = 1").select("id"), "id", "left_semi")


def reasoning_edges(edges: DataFrame) -> DataFrame:
    """Active edges whose generation method takes part in traversal."""
    method = F.coalesce("generation_method", F.lit(""))
    return active(edges).where(~method.isin(O.GRAPH_EXCLUDED_METHODS))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int = O.GRAPH_MAX_HOPS) -> DataFrame:
    """(qid, id) within ``depth`` undirected hops of the seeds, seeds left out.

    Each hop joins only the newly found nodes; known ones are anti-joined, so
    a node is expanded once.
    """
    pool = endpoints(reasoning_edges(edges)).select("nid", "nbr")
    seen = seeds.select("qid", "id").distinct()
    frontier = held(seen, HELD)
    for hop in range(depth):
        step = (frontier.join(pool, frontier["id"] == pool["nid"])
                .select("qid", F.col("nbr").alias("id")).distinct())
        frontier = step.join(seen, ["qid", "id"], "left_anti")
        if hop + 1 < depth:
            frontier = held(frontier, HELD)  # of known size: a short one is sent to the edges
        seen = seen.unionAll(frontier)
    return seen.join(seeds, ["qid", "id"], "left_anti")


def best_edge_class(edges: DataFrame, seeds: DataFrame, found: DataFrame) -> DataFrame:
    """Strongest class among edges that join a found node to a seed directly; '' where there is none."""
    pool = endpoints(active(edges), "relation")
    direct = (pool.join(seeds, seeds["id"] == pool["nid"])
              .select("qid", F.col("nbr").alias("id"), O.edge_class(F.col("relation")).alias("edge_class")))
    best = best_row(direct, ["qid", "id"], O.lookup(O.EDGE_CLASS_RANK, F.col("edge_class"), 0), ["edge_class"])
    return (found.join(best, ["qid", "id"], "left")
            .withColumn("edge_class", F.coalesce("edge_class", F.lit(""))))


def visits_of(nodes: DataFrame) -> DataFrame:
    visits = F.when(F.coalesce("visit_count", F.lit(0)) > 0, F.col("visit_count")).otherwise(1)
    return nodes.select("id", visits.cast("bigint").alias("visits"))


def build_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Traversal adjacency of one snapshot, written once and read by every hop and request.

    One row per (edge, end) of the live reasoning edges, with the neighbour's visits.
    """
    pool = endpoints(reasoning_edges(live_edges(nodes, edges)), "relation", "strength", "generation_method")
    return cut_lineage(pool.join(visits_of(nodes).withColumnRenamed("id", "nbr"), "nbr"))


def graph_at(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``build_graph`` around a list of nodes: only edges that end in one of them are checked and shuffled."""
    near = live_edges(nodes, edges_at(reasoning_edges(edges), ids))
    own = ids.select(F.col("id").alias("nid")).distinct()
    pool = endpoints(near, "relation", "strength", "generation_method").join(own, "nid", "left_semi")
    return pool.join(visits_of(nodes).withColumnRenamed("id", "nbr"), "nbr")


def ucb_traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = O.GRAPH_MAX_HOPS,
                 width: int = O.TRAVERSAL_WIDTH, apply_penalty: bool = False, graph: DataFrame | None = None) -> DataFrame:
    """Upper-confidence traversal: per hop the ``width`` best unvisited neighbours of each query.

    ``seeds`` has (qid, id, c). Parallel edges of one direction collapse to the
    latest; an outgoing edge is preferred to an incoming one. The frontier has
    at most ``width`` rows per query. While it is short it is sent to the
    edges (or to the ``graph`` of ``build_graph``, where many batches share one), so that only
    those it touches are shuffled; the frontier of a large batch is a checkpoint and joined by id.
    """
    known = held(visits_of(nodes).join(seeds.select("id").distinct(), "id", "left_semi"), HELD)
    frontier = held(seeds.join(known, "id", "left").select("qid", "c", "id", F.coalesce("visits", F.lit(1)).alias("n_i")), HELD)
    seen, out = frontier.select("qid", "id"), None
    for _ in range(depth):
        pool = graph_at(nodes, edges, frontier.select("id")) if graph is None else graph
        hop = (pool.join(frontier.withColumnRenamed("id", "nid"), "nid")
               .withColumnRenamed("nbr", "id").join(seen, ["qid", "id"], "left_anti"))
        hop = best_row(hop, ["qid", "c", "nid", "n_i", "id", "visits"], F.struct("out", "edge_id"),
                       ["relation", "strength", "generation_method"])
        weight = F.coalesce("strength", F.lit(0.1)) * O.family_weight(F.col("relation"))
        if apply_penalty:
            weight = weight + O.lookup(O.GENERATION_METHOD_PENALTY, F.col("generation_method"), 0.0)
        bonus = F.col("c") * F.sqrt(F.log(F.col("n_i") + 1.0) / (F.col("visits") + 1))
        hop = (hop.withColumn("score", F.round(F.greatest(weight, F.lit(0.0)) + bonus, 9))
               .withColumn("edge_class", O.edge_class(F.col("relation")))
               .withColumn("class_rank", O.lookup(O.EDGE_CLASS_RANK, F.col("edge_class"), 0)))
        hop = best_row(hop, ["qid", "c", "id", "visits"], F.struct("score", "class_rank"), ["score", "edge_class"])
        picked = held(top_per_group(hop, ["qid"], [F.desc("score"), F.desc("id"), F.desc("edge_class")], width), HELD)
        found = picked.select("qid", "id", "edge_class")
        out = found if out is None else out.unionAll(found)
        seen = seen.unionAll(found.select("qid", "id"))
        frontier = picked.select("qid", "c", "id", F.col("visits").alias("n_i"))
    return out


def explore(edges: DataFrame, seeds: DataFrame, depth: int = O.GRAPH_MAX_HOPS, floor: float = 0.3,
            chance: float = 0.0, seed: int = 7) -> DataFrame:
    """Reachability over strong edges; a weak edge is followed with probability ``chance``."""
    strong = F.coalesce("strength", F.lit(0.0)) >= floor
    return reachable(edges.where(strong | (F.rand(seed) < chance)) if chance else edges.where(strong), seeds, depth)


def shortest_paths(edges: DataFrame, source: int, target: int | None = None) -> DataFrame:
    """Breadth-first tree from one node: hop count and smallest-id parent of every node reached.

    Ends when a hop finds nothing new or, where a ``target`` is asked for, has found it. The adjacency is written once.
    """
    pool = cut_lineage(endpoints(active(edges)).select("nid", "nbr").distinct())
    seen = edges.sparkSession.createDataFrame([(source, 0, None)], "id bigint, hop int, parent bigint")
    frontier = seen
    hop = 0
    while True:
        hop += 1
        step = (frontier.join(pool, frontier["id"] == pool["nid"])
                .groupBy(F.col("nbr").alias("id")).agg(F.min("nid").alias("parent")))
        frontier = cut_lineage(step.join(seen, "id", "left_anti")
                               .select("id", F.lit(hop).alias("hop"), "parent"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)
        if target is not None and not frontier.where(F.col("id") == target).isEmpty():
            return seen


def path_labels(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Label of the tree edge into each node: the relation, marked when it runs against the path."""
    named = endpoints(active(edges), "relation")
    label = F.when(F.col("out"), F.col("relation")).otherwise(F.concat(F.lit("<-"), F.col("relation")))
    hit = (tree.where("parent is not null").join(named, (F.col("parent") == F.col("nid")) & (F.col("id") == F.col("nbr")))
           .withColumn("label", label))
    return best_row(hit, ["id", "hop", "parent"], F.struct(~F.col("out"), F.col("edge_id")), ["label"], largest=False)


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of an undirected pair list (a, b): (id, component = smallest id).

    Alternates the large-star and small-star steps, which halve path lengths
    per round and never hand one task a whole neighbourhood: only minima are
    aggregated, with map-side combine. It ends at the fixed point, after
    however many rounds.
    """
    def ends(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def large_star(e: DataFrame) -> DataFrame:
        both = ends(e)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return linked.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    cur = cut_lineage(pairs.where("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        cur = cut_lineage(small_star(large_star(cur)).where("a <> b"))
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        mark = state
    roots = cur.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def dense_clusters(nodes: DataFrame, edges: DataFrame, min_size: int = 10, max_size: int = 15) -> DataFrame:
    """Greedy star clusters around the 50 nodes of highest degree.

    Only 50 seeds and 14 neighbours each reach the greedy step, so it may run
    on the driver whatever the size of the graph.
    """
    seeds = degree(edges).orderBy(F.desc("degree"), "id").limit(50)
    pool = endpoints(edges).select("nid", "nbr").join(seeds.select(F.col("id").alias("nid")), "nid").distinct()
    # one aggregate per seed would hold a hub's whole neighbourhood; the rank limit does not
    near = top_per_group(pool, ["nid"], [F.col("nbr")], max_size - 1)
    alive = near.join(active(nodes).select(F.col("id").alias("nbr")), "nbr", "left_semi").groupBy("nid").agg(
        F.count("*").alias("alive"))
    lists = near.groupBy("nid").agg(F.sort_array(F.collect_set("nbr")).alias("members"))
    rows = (seeds.join(lists, seeds["id"] == lists["nid"]).join(alive, "nid", "left")
            .join(active(nodes).select(F.col("id"), F.lit(1).alias("seed_alive")), "id", "left")
            .orderBy(F.desc("degree"), "id")
            .select("id", "degree", "members", F.coalesce("alive", F.lit(0)), F.coalesce("seed_alive", F.lit(0)))
            .collect())
    taken: set[int] = set()
    out = []
    for seed, deg, members, n_alive, seed_alive in rows:
        if seed in taken or len(members) + 1 < min_size or n_alive + seed_alive < min_size:
            continue
        out.append((seed, deg, members))
        taken.update([seed, *members])
    return edges.sparkSession.createDataFrame(out, "seed bigint, degree bigint, members array<bigint>")


def temporal_sequences(nodes: DataFrame, per_project: int = 20, min_len: int = 3) -> DataFrame:
    """The earliest nodes of each project in order; short sequences are dropped."""
    named = active(nodes).where("project <> ''").select("id", "project", "created_at")
    first = top_per_group(named, ["project"], [F.col("created_at"), F.col("id")], per_project, "pos")
    return first.withColumn("len", F.count("*").over(Window.partitionBy("project"))).where(F.col("len") >= min_len)


def inspect(nodes: DataFrame, edges: DataFrame, node_id: int) -> DataFrame:
    """Incoming and outgoing live edges of a node with the neighbour's summary."""
    own = edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    ends = endpoints(live_edges(nodes, own), "relation", "strength").where(F.col("nid") == node_id)
    other = active(nodes).select(F.col("id").alias("nbr"), "type",
                                 F.substring(F.coalesce("summary", "content"), 1, 100).alias("preview"))
    return ends.join(other, "nbr").select(
        F.when(F.col("out"), "outgoing").otherwise("incoming").alias("direction"),
        "edge_id", "relation", "strength", F.col("nbr").alias("neighbour_id"), "type", "preview")


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Live edges between members of an id set."""
    return (live_edges(nodes, edges)
            .join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
            .join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi"))
