"""Scenario matrix: engine x k x pools x round, timed and scored, and its summary document."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators import evaluate
from vectorloom.operators.exact import knn_batch
from vectorloom.operators.ivf import IvfIndex, search_ivf
from vectorloom.operators.pq import PqIndex, search_pq
from vectorloom.session import materialize


@dataclass(frozen=True)
class Dataset:
    """Base table and sampled queries of one evaluation."""

    base: DataFrame
    queries: DataFrame
    query_count: int
    gt_width: int
    id_col: str = "id"
    vec_col: str = "embedding"


def run_search(data: Dataset, engine, k: int, nprobe: int, dop: int) -> DataFrame:
    if engine == "fullscan":
        return knn_batch(data.base, data.queries, k, data.id_col, data.vec_col)
    if isinstance(engine, IvfIndex):
        return search_ivf(engine, data.queries, k, nprobe)
    if isinstance(engine, PqIndex):
        return search_pq(engine, data.queries, k, nprobe, dop)
    raise ValueError(f"unknown engine {engine!r}")


def score_engines(
    data: Dataset, searches: dict[str, DataFrame], ks: list[int], truth: DataFrame
) -> DataFrame:
    """Recall of several engines for all ``ks``: ``(engine, k, hits…, recall…)``.

    Each search holds the largest ``k`` and runs once; the union of their results is scored in one pass.
    """
    union = None
    for name, found in searches.items():
        named = found.select(F.lit(name).alias("engine"), "query_index", "rk", "id", "dist")
        union = named if union is None else union.unionByName(named)
    scored = [k for k in ks if k <= data.gt_width]
    thresholds = evaluate.thresholds_by_k(
        truth, data.queries, data.base, scored or [1], id_col=data.id_col, vec_col=data.vec_col
    )
    return evaluate.recall_by_engine(
        materialize(union, "results"), truth, thresholds, list(searches), ks, data.query_count, data.gt_width
    )


def run_matrix(
    data: Dataset,
    engines: dict[str, object],
    ks: list[int],
    dops: list[int],
    rounds: int = 1,
    nprobe: int = 10,
    warmup: int = 1,
) -> DataFrame:
    """Timed scenarios with recall: one row per engine, k, number of pools and round.

    A scenario is one distributed batch search, so its time is that of all queries together;
    ``qps`` is queries per second of it. Warm-up searches run untimed. Only engines with pools are run
    once per entry of ``dops``: another label on the same search would measure nothing.
    """
    spark: SparkSession = data.base.sparkSession
    truth = materialize(
        knn_batch(data.base, data.queries, min(data.gt_width, 100), data.id_col, data.vec_col), "truth"
    )
    variants = {
        (name, dop): engine
        for name, engine in engines.items()
        for dop in (dops if isinstance(engine, PqIndex) else dops[:1])
    }
    searches = {f"{name}/{dop}": run_search(data, e, max(ks), nprobe, dop) for (name, dop), e in variants.items()}
    metrics = score_engines(data, searches, ks, truth)
    metrics = metrics.withColumns(
        {"dop": F.substring_index("engine", "/", -1).cast("int"), "engine": F.substring_index("engine", "/", 1)}
    )
    times = []
    for (name, dop), engine in variants.items():
        for k in ks:
            for _ in range(warmup):
                run_search(data, engine, k, nprobe, dop).write.format("noop").mode("overwrite").save()
            for number in range(1, rounds + 1):
                started = time.monotonic()
                run_search(data, engine, k, nprobe, dop).write.format("noop").mode("overwrite").save()
                times.append((name, k, dop, number, (time.monotonic() - started) * 1000.0))
    timed = spark.createDataFrame(times, "engine string, k int, dop int, round int, elapsed_ms double")
    return timed.join(metrics, ["engine", "k", "dop"]).withColumn(
        "qps", F.lit(data.query_count) / (F.col("elapsed_ms") / 1000.0)
    )


def matrix_summary(scenarios: DataFrame, axes: list[str]) -> DataFrame:
    """One row: ``axes``, a struct with the sorted values of every axis, and ``scenarios``, all rows in their order.

    A matrix has as many rows as its axes have combinations, so the document is bounded by them.
    """
    values = [F.array_sort(F.collect_set(axis)).alias(axis) for axis in axes]
    rest = [c for c in scenarios.columns if c not in axes]
    rows = F.array_sort(F.collect_list(F.struct(*axes, *rest)))
    return scenarios.agg(F.count("*").alias("total"), F.struct(*values).alias("axes"), rows.alias("scenarios"))


def write_matrix_summary(scenarios: DataFrame, axes: list[str], path: str) -> None:
    """The summary as one JSON document below ``path``."""
    matrix_summary(scenarios, axes).coalesce(1).write.json(path)
