"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from loomgraph.plans import PLANS
from loomgraph.session import build_session

HEADLINE = [
    "ret01_vector_search", "ret04_text_search_bm25", "ret15_hybrid_scoring", "ret34_auto_link", "gr01_reachable_two_hops",
    "gr03_ucb_traversal", "gr06_shortest_paths", "gr11_orphans", "gr15_connected_components", "gr20_co_retrieval",
    "gr21_cross_domain_clusters", "jn15_similar_pairs", "lc01_sprt", "lc07_edge_decay", "lc08_edge_pruning", "lc13_batch_growth",
    "lc15_promotion_candidates", "cu02_same_source_duplicates", "cu11_repair_edge_audit", "qc01_data_integrity", "rp01_health_snapshot",
    "rp02_growth_audit", "cx01_session_sections", "ts03_cycle_check", "tr04_evidence_boost", "ev03_rrf_sweep", "src05_markdown_chunks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("loomgraph-bench")
    spark.sparkContext.setLogLevel("ERROR")
    PLANS["qc04_distributions"](spark, folder).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf.group(1)) if sf else None, "cpus": int(os.environ.get("BENCH_CPUS", "8"))}))
    spark.stop()


if __name__ == "__main__":
    main()
