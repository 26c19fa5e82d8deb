"""All named queries."""

from . import catalog_boundary, catalog_labels, catalog_reviews  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
