"""Registered queries and the SQL they are checked against.

Each module binds operators to the given tables; its QUERIES and ORACLE_SQL have equal keys
where SQL can express the query.
"""

from __future__ import annotations

from tidewell.plans import acquisition, arrays, bounds, competition, evidence, grouping, kernels, matching, products, runs, series, statistics, text

_MODULES = (acquisition, competition, matching, series, statistics, arrays, grouping, text, kernels, bounds, evidence, products, runs)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
