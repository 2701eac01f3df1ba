"""Named queries over the given tables, each with its SQL twin where one exists."""

from seriesloom.plans import features, merging, models, prepare, scoring, splits, streams, windows  # noqa: F401
from seriesloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
