"""Registered queries with their SQL checks."""

from loomgraph.plans import (  # noqa: F401
    context_plans, curation_plans, enrichment_plans, graph_plans, lifecycle_plans, quality_plans, retrieval_plans,
    table_plans, verification_plans,
)
from loomgraph.plans.registry import PLANS  # noqa: F401
