"""Queries over the driver's tables."""

from . import catalog, facts, flows, scores, sources, upkeep  # noqa: F401 - the others add their queries to the catalog
