"""Scans, lookups, filters and snapshot writes on the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.operators.graph import active


def filtered(df: DataFrame, since: str = "", **equal) -> DataFrame:
    """Conjunction of the filters actually given; all of them reach the scan."""
    for name, value in equal.items():
        if value not in ("", None, []):
            df = df.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return df.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")) if since else df


def recent_nodes(nodes: DataFrame, project: str = "", limit: int = 10, node_type: str = "") -> DataFrame:
    return filtered(active(nodes), project=project, type=node_type).orderBy(F.desc("created_at"), "id").limit(limit)


def lookup_ids(df: DataFrame, ids: list[int], active_only: bool = True) -> DataFrame:
    """Rows of the ids asked for; the id filter and the status filter reach the scan."""
    rows = df.where(F.col("id").isin(ids))
    return active(rows) if active_only else rows


def by_hash(nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    return active(nodes).join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")


def text_filter(df: DataFrame, word: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring in any of the columns."""
    return df.where(O.any_of([F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(word.lower())) for c in columns]))


# --- snapshot writes -------------------------------------------------------

def insert_nodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of inserting rows (id, type, content_hash, layer): a known or repeated hash is a duplicate.

    The owner of every hash is a minimum per hash, so copies of one content
    are combined map-side.
    """
    known = existing.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("id").alias("known_id"))
    first = incoming.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("id").alias("first_id"))
    rows = incoming.join(first, "content_hash", "left").join(known, "content_hash", "left")
    owner = F.coalesce("known_id", F.when(F.col("first_id") != F.col("id"), F.col("first_id")))
    return rows.select("id", F.when(owner.isNull(), "inserted").otherwise("duplicate").alias("outcome"), owner.alias("existing_id"),
                       F.coalesce("layer", O.lookup(O.PROMOTE_LAYER, F.col("type"))).alias("layer"),
                       F.coalesce(F.nullif("node_role", F.lit("")), F.lit("knowledge_candidate")).alias("node_role"))


def insert_edges(edges: DataFrame) -> DataFrame:
    """Stored relation of each edge, and whether a correction row is due."""
    new = O.canonical_relation(F.col("relation"))
    return edges.select("id", F.col("relation").alias("asked"), new.alias("stored"), (new != F.col("relation")).alias("corrected"))


def guard_edges(proposed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed edges whose ends exist and whose triple is new; unknown relations become connects_with."""
    rel = F.when(F.col("relation").isin(O.KNOWN_RELATIONS), F.col("relation")).otherwise("connects_with")
    ids = nodes.select("id")
    known = edges.select("source_id", "target_id", "relation").distinct()
    return (proposed.withColumn("relation", rel)
            .join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
            .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
            .join(known, ["source_id", "target_id", "relation"], "left_anti"))


def correction_rows(edges: DataFrame, as_of: str, by: str = "system") -> DataFrame:
    """Audit rows of the relations that were stored under another name than asked for."""
    return insert_edges(edges).where("corrected").select(
        F.lit(0).cast("bigint").alias("node_id"), F.col("id").alias("edge_id"), F.lit("relation").alias("field"), F.col("asked").alias("old_value"),
        F.col("stored").alias("new_value"), F.lit("canonical relation").alias("reason"), F.lit(by).alias("corrected_by"),
        F.lit(as_of).cast("timestamp_ntz").alias("created_at"))


def count_up(counters: DataFrame, happened: DataFrame) -> DataFrame:
    """Text counters (key, value) after one more for every row of ``happened`` (key): the leading digits count, anything else is 0."""
    more = happened.groupBy("key").agg(F.count("*").alias("n"))
    held = F.coalesce(F.regexp_extract(F.coalesce("value", F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))
    return counters.join(more, "key", "full_outer").select(
        "key", F.when(F.col("n").isNull(), F.col("value")).otherwise((held + F.col("n")).cast("string")).alias("value"))


def replace_day(snapshots: DataFrame, fresh: DataFrame, day: str = "snapshot_date") -> DataFrame:
    """Snapshots with the days of ``fresh`` taken from there, as one overwrite of those partitions would leave them."""
    return snapshots.join(fresh.select(day).distinct(), day, "left_anti").unionByName(fresh)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """New snapshot: rows of ``new`` replace those of ``old`` with the same key, but for the ``keep`` columns."""
    keep = keep or []
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols if c in new.columns], F.lit(True).alias("_hit"))
    both = old.join(n, keys, "full_outer")

    def pick(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        return F.coalesce(c, f"_n_{c}").alias(c) if c in keep else F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*keys, *[pick(c) for c in cols])


def dirty_topics(nodes: DataFrame) -> DataFrame:
    """Topic and node of every dirty mark; one row per pair, so no topic is one long list."""
    topic = F.coalesce(F.nullif(F.lower(F.trim("project")), F.lit("")), F.lit("uncategorized"))
    return nodes.select(topic.alias("topic"), F.col("id").alias("node_id")).distinct()


def clear_topics(marks: DataFrame, topics: list[str] | None = None) -> DataFrame:
    return marks.where(~F.col("topic").isin(topics)) if topics else marks.limit(0)


def export_graph(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, project: str = "") -> tuple[DataFrame, DataFrame]:
    """Exported nodes, and the active edges both of whose ends are exported."""
    out = filtered(active(nodes), type=types or "", project=project)
    ids = out.select("id")
    inside = (active(edges).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
              .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"))
    return out, inside


def validate_types(rows: DataFrame, type_defs: DataFrame) -> DataFrame:
    """Type name checked exactly, then ignoring case; a deprecated one names its successor."""
    exact = F.broadcast(type_defs.select(F.col("name").alias("type"), F.col("status").alias("s1"), F.col("replaced_by").alias("r1")))
    loose = F.broadcast(type_defs.select(F.lower("name").alias("low"), F.col("name").alias("n2"), F.col("status").alias("s2"),
                                         F.col("replaced_by").alias("r2")))
    both = rows.withColumn("low", F.lower("type")).join(exact, "type", "left").join(loose, "low", "left")
    status = F.coalesce("s1", "s2")
    fixed = F.when(status == "deprecated", F.coalesce("r1", "r2")).when(F.col("s1").isNotNull(), F.col("type")).otherwise(F.col("n2"))
    return both.select("id", "type", F.coalesce((F.col("s1") == "active"), F.lit(False)).alias("valid"), fixed.alias("corrected"))


def project_isolated(nodes: DataFrame, edges: DataFrame, types: list[str], first: list[str], limit: int = 200) -> DataFrame:
    """Knowledge nodes no active edge joins to another project, the leading types first."""
    from loomgraph.operators.graph import endpoints

    named = nodes.where("project <> ''").select("id", "project")
    own = named.select(F.col("id").alias("nid"), F.col("project").alias("p"))
    other = named.select(F.col("id").alias("nbr"), F.col("project").alias("q"))
    crossing = endpoints(active(edges)).join(own, "nid").join(other, "nbr").where("p <> q").select(F.col("nid").alias("id")).distinct()
    rows = active(nodes).where(F.col("type").isin(types) & (F.col("project") != "")).join(crossing, "id", "left_anti")
    return rows.orderBy(F.col("type").isin(first).desc(), F.desc_nulls_last("visit_count"), "id").limit(limit)
