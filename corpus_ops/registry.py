"""All queries of the engine's core, and SQL with the same results."""

from __future__ import annotations

from .operators import chat, corpus, mapping, packing, runs
from .plans import planner

_MODULES = (corpus, chat, runs, packing, planner, mapping)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
