"""Query catalog: operators wired to the test tables, each with its SQL check."""

from hourline.plans import cleaning_queries, feature_queries, model_queries, score_queries  # noqa: F401
from hourline.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
