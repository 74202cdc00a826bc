"""All queries of the protocol's tables, with their SQL."""

from __future__ import annotations

from tidemark.plans import entities, feeds, hashes, history, operations, rollups, routes, stake, states, valuation  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL  # noqa: F401
