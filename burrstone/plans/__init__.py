"""Registered queries by topic."""

from burrstone.plans import aggregates, graphs, joins, ordering, patterns, scalars, sources, streams  # noqa: F401
