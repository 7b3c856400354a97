"""What a query's physical plan holds: joins, exchanges, scans.

Before a query ran, its plan is the one that hints and statistics chose; after
it ran, adaptive execution may have changed it.  Both can be read here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

JOIN_NODES = ("BroadcastHashJoin", "ShuffledHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct")
_TYPES = ("Inner", "LeftOuter", "RightOuter", "FullOuter", "LeftSemi", "LeftAnti", "Cross", "ExistenceJoin")


@dataclass(frozen=True)
class JoinNode:
    node: str
    join_type: str
    build: str | None


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def logical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _current(plan: str) -> str:
    """Of an adaptive plan that ran, the final part only."""
    if "== Final Plan ==" in plan:
        return plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return plan


def _initial(plan: str) -> str:
    return plan.split("== Initial Plan ==", 1)[1] if "== Initial Plan ==" in plan else plan


def joins(df: DataFrame, initial: bool = False) -> list[JoinNode]:
    """The plan's joins from the top down."""
    plan = physical_plan(df)
    found = []
    for line in (_initial(plan) if initial else _current(plan)).splitlines():
        m = re.match(rf"[\s:+\-*()\d]*?({'|'.join(JOIN_NODES)})\b(.*)", line)
        if m:
            rest = m[2]
            kind = next((t for t in _TYPES if re.search(rf"\b{t}\b", rest)), "Inner")
            build = re.search(r"Build(Left|Right)", rest)
            found.append(JoinNode(m[1], kind, build[1].lower() if build else None))
    return found


def exchanges(df: DataFrame) -> list[str]:
    return re.findall(r"\b((?:Broadcast)?Exchange) ", _current(physical_plan(df)))


def scans(df: DataFrame) -> list[dict[str, str]]:
    """Columns read, and filters pushed into each file scan."""
    out = []
    for line in _current(physical_plan(df)).splitlines():
        if "FileScan" in line:
            pushed = re.search(r"PushedFilters: \[(.*?)\]", line)
            schema = re.search(r"ReadSchema: struct<(.*?)>", line)
            out.append({"pushed": pushed[1] if pushed else "", "columns": schema[1] if schema else ""})
    return out
