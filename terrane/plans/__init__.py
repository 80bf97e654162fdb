"""Queries over the given tables, and their SQL."""

from __future__ import annotations

from terrane.plans import catalogue, cohort, demographics, drift, geometry, models, order, paths, replication, strata, typing

_MODULES = (catalogue, cohort, strata, drift, models, geometry, order, typing, demographics, paths, replication)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
