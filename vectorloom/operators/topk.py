"""Rank and cut: per query, per worker, single statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_K = 10_000


def check_k(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must lie in 1..{MAX_K}, got {k}")


def fetch_k(k) -> int:
    """Candidates one worker may return before exact re-ranking."""
    return min(max(5 * k, 50), MAX_K)


def fetch_k_column(k: Column) -> Column:
    return F.least(F.greatest(k * 5, F.lit(50)), F.lit(MAX_K))


def top_per_group(
    df: DataFrame, limit: int, group: list[str], order: list[str], rank: str = "rk"
) -> DataFrame:
    """First ``limit`` rows of every group; map-side pruned by ``WindowGroupLimit``."""
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)


def top_per_query(candidates: DataFrame, k: int, dist: str = "dist") -> DataFrame:
    """``k`` nearest per query; equal distances go to the lower id."""
    return top_per_group(candidates, k, ["query_index"], [dist, "id"])


def cap_per_worker(candidates: DataFrame, limit: int, dist: str = "adc") -> DataFrame:
    """At most ``limit`` candidates per query and worker."""
    return top_per_group(
        candidates, limit, ["query_index", "worker"], [dist, "id"], rank="worker_rk"
    )
