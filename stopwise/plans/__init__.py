"""Plans: registered queries over the given tables."""

from stopwise.plans import core, domain, ingest, models, network_graph, profiles, profiles_detail, quality, relational, streams  # noqa: F401
from stopwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
