"""Every query of the engine by name, and its SQL."""

from __future__ import annotations

from folioscope.plans import numbered_queries, page_queries, revision_queries, rule_queries, tree_queries

QUERIES: dict = {**revision_queries.QUERIES, **page_queries.QUERIES, **tree_queries.QUERIES, **rule_queries.QUERIES, **numbered_queries.QUERIES}
ORACLES: dict[str, str] = {**revision_queries.ORACLES, **page_queries.ORACLES, **tree_queries.ORACLES, **rule_queries.ORACLES, **numbered_queries.ORACLES}
