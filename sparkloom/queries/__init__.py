"""Named queries over the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

from . import joins, relational, tpch

QUERIES = joins.QUERIES | relational.QUERIES | tpch.QUERIES
ORACLES = joins.ORACLES | relational.ORACLES | tpch.ORACLES
