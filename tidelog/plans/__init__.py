"""All registered queries; importing the modules fills the registry."""

from tidelog.plans import corpus_queries, feature_queries, ranking_queries, readout_queries, target_queries  # noqa: F401
from tidelog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
