"""All registered queries."""

from panelark.plans import catalog_features, catalog_inference, catalog_jobs, catalog_linear, catalog_portfolio  # noqa: F401
from panelark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
