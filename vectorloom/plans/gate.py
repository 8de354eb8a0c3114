"""Checks on the physical plan of a search before it is timed."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Which operators a plan must show, by kind of search.
REQUIRED = {
    "single": ["TakeOrderedAndProject"],
    "batch": ["WindowGroupLimit"],
    "index": ["WindowGroupLimit", "PartitionFilters: [list_id"],
}


class PlanError(RuntimeError):
    """The optimizer did not choose the expected plan."""


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()


def absent_markers(plan: str, markers: list[str]) -> list[str]:
    low = plan.lower()
    return [m for m in markers if m.lower() not in low]


def check_plan(df: DataFrame, kind: str, extra: list[str] | None = None) -> str:
    """Plan text, or an error naming the markers that are absent."""
    plan = plan_text(df)
    missing = absent_markers(plan, REQUIRED[kind] + (extra or []))
    if missing:
        raise PlanError(f"plan of a {kind} search lacks: " + ", ".join(missing))
    return plan
