import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loomgraph.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("loomgraph-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def graph(spark):
    """Small graph: hub 1, triangle 1-2-3, tail 3-4, self-loop on 5, archived node 6, isolated 7."""
    nodes = spark.createDataFrame(
        [(1, "Signal", 1, "active", "a", 3, 0.9), (2, "Pattern", 2, "active", "a", 0, None), (3, "Decision", 1, "active", "b", 12, 0.2),
         (4, "Failure", 1, "active", "", 1, 0.1), (5, "Insight", 2, "active", "b", 5, None), (6, "Goal", 1, "archived", "c", 0, 0.5),
         (7, "Question", 0, "active", "c", 0, None)],
        "id bigint, type string, layer int, status string, project string, visit_count bigint, quality_score double")
    edges = spark.createDataFrame(
        [(10, 1, 2, "led_to", 0.9, "active", "rule"), (11, 2, 3, "supports", 0.4, "active", "rule"), (12, 3, 1, "contradicts", 0.5, "active", ""),
         (13, 3, 4, "contains", 0.2, "active", "semantic_auto"), (14, 5, 5, "supports", 0.5, "active", "rule"), (15, 1, 6, "led_to", 0.5, "active", "rule"),
         (16, 1, 2, "connects_with", 0.1, "active", "rule"), (17, 4, 7, "led_to", 0.9, "archived", "rule"), (18, 1, 7, "led_to", 0.9, "active", "orphan_repair")],
        "id bigint, source_id bigint, target_id bigint, relation string, strength double, status string, generation_method string")
    return nodes, edges
