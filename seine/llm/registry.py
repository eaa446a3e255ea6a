"""Queries of the training-data operators and the SQL they are compared with."""

from __future__ import annotations

from seine.llm import queries as _q

QUERIES = _q.QUERIES
ORACLES = _q.ORACLES
