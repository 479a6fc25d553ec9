"""The check runner: modules of checks, each a frame of rows, run as one and appended to a log."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.operators.quality import CHECK_COLS

LOG = "check_name string, category string, score double, threshold double, status string, details string, created_at timestamp_ntz, run_id string"
#: Types that rules may still name though they are no longer declared.
RETIRED_TYPES = ["Evidence", "Heuristic", "Concept"]


def schema_checks(types: DataFrame, relations: DataFrame, type_defs: DataFrame, relation_defs: DataFrame) -> DataFrame:
    """Seven checks of constants against the declared names (name) and of these against the stored ones (name, status).

    ``score`` is the number of names that do not fit, ``details`` lists them (catalog names, a few dozen at most).
    """
    spark = types.sparkSession
    names = lambda values: spark.createDataFrame([(v,) for v in sorted(set(values))], "name string")
    ruled = [x for source, targets in O.RELATION_RULES.items() for x in (source, *targets)]
    promoted = [x for source, targets in O.VALID_PROMOTIONS.items() for x in (source, *targets)]
    valid = [*O.PROMOTE_LAYER, *RETIRED_TYPES]
    placed, known = names(set(O.PROMOTE_LAYER) - {"Unclassified", *RETIRED_TYPES}), names(O.KNOWN_RELATIONS)
    less = lambda a, b: a.join(b, "name", "left_anti").select("name").distinct()
    odd = {
        "promote_layer_in_schema": (less(placed, types), "FAIL"),
        "schema_in_promote_layer": (less(types.where(~F.col("name").isin("Unclassified", *RETIRED_TYPES)), names(O.PROMOTE_LAYER)), "WARN"),
        "all_relations_match_schema": (less(known, relations).union(less(relations, known)), "FAIL"),
        "relation_rules_types_valid": (less(names(ruled), names(valid)), "FAIL"),
        "valid_promotions_types_valid": (less(names(promoted), names(valid)), "FAIL"),
    }
    rows = [listed(name, frame, bad) for name, (frame, bad) in odd.items()]
    for name, stored, declared in (("type_defs_count", type_defs, types), ("relation_defs_count", relation_defs, relations)):
        gap = stored.where("status = 'active'").agg(F.count("*").alias("s")).join(declared.agg(F.count_distinct("name").alias("d")), how="cross")  # one row beside one row
        rows.append(gap.select(F.lit(name).alias("name"), F.lit("schema").alias("category"), F.abs(F.col("s") - F.col("d")).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"),
                               F.when(F.col("s") == F.col("d"), "PASS").otherwise("WARN").alias("status"), F.to_json(F.struct(F.col("s").alias("stored"), F.col("d").alias("declared"))).alias("details")))
    return reduce(DataFrame.unionAll, rows)


def listed(name: str, odd: DataFrame, bad: str) -> DataFrame:
    one = odd.agg(F.count("*").cast("double").alias("n"), F.to_json(F.sort_array(F.collect_set("name"))).alias("details"))
    return one.select(F.lit(name).alias("name"), F.lit("schema").alias("category"), F.col("n").alias("score"), F.lit(None).cast("double").alias("threshold"),
                      F.when(F.col("n") == 0, "PASS").otherwise(bad).alias("status"), "details")


def run_checks(spark: SparkSession, modules: dict[str, Callable[[], DataFrame]], run_id: str, as_of: str, path: str) -> DataFrame:
    """Runs every module, appends its rows to the log and returns the run's rows of the log.

    A module that fails is a FAIL row of its own, named after it, with the error; the others run all the same. Each module is
    written as soon as it is done, so what has run is in the log.
    """
    for name, module in modules.items():
        try:
            logged(module(), run_id, as_of).write.mode("append").partitionBy("run_id").parquet(path)
        except Exception as e:  # noqa: BLE001
            row = spark.createDataFrame([(name, "error", None, None, "FAIL", json.dumps({"error": str(e).splitlines()[0][:200]}))], "name string, category string, score double, threshold double, status string, details string")
            logged(row, run_id, as_of).write.mode("append").partitionBy("run_id").parquet(path)
    return spark.read.schema(LOG).parquet(path).where(F.col("run_id") == run_id)


def logged(checks: DataFrame, run_id: str, as_of: str) -> DataFrame:
    """Rows of the verification log; checks without details have an empty object."""
    details = F.col("details") if "details" in checks.columns else F.lit("{}")
    name, *rest = CHECK_COLS
    return checks.select(F.col(name).alias("check_name"), *rest, details.alias("details"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"), F.lit(run_id).alias("run_id"))


def summary(log: DataFrame) -> DataFrame:
    """(run_id, status, checks) of every run."""
    return log.groupBy("run_id", "status").agg(F.count("*").alias("checks"))
