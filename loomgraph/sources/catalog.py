"""Small declared inputs: the type catalog and the judged query set, both YAML files read on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph import ontology as O


def declared_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, description) of the node types and of the relation types of a catalog file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f)

    def rows(kind: str) -> DataFrame:
        items = [(k, (v or {}).get("description", "")) for k, v in (doc.get(kind) or {}).items()]
        return spark.createDataFrame(items, "name string, description string")

    return rows("node_types"), rows("relation_types")


def judged_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, node_id, grade): relevant items grade 1, also relevant ones 0.5."""
    import yaml

    with open(path, encoding="utf-8") as f:
        items = yaml.safe_load(f).get("queries", [])
    rows = [(str(q["id"]), q["query"], int(n), g) for q in items
            for key, g in (("relevant_ids", 1.0), ("also_relevant", 0.5)) for n in q.get(key) or []]
    return spark.createDataFrame(rows, "qid string, query string, node_id bigint, grade double")


def type_defs(spark: SparkSession, retired: dict[str, str] | None = None) -> DataFrame:
    rows = [(t, "active", None) for t in O.ACTIVE_TYPES] + [(t, "deprecated", r) for t, r in (retired or {}).items()]
    return spark.createDataFrame(rows, "name string, status string, replaced_by string")
