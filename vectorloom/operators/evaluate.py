"""Recall, latency and scenario metrics.

Inputs are long tables: results ``(query_index, rk, id, dist)``, truth
``(query_index, rk, id, …)``, timings ``(…, elapsed_ms)``. Everything is aligned by
``query_index``, never by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.functions.text import scenario_label
from vectorloom.functions.vector import l2_distance_batch
from vectorloom.operators.exact import knn_batch
from vectorloom.operators.joins import join_null_safe
from vectorloom.operators.percentiles import percentile_table
from vectorloom.operators.topk import MAX_K

#: Slack added to the k-th true distance, so that ties count as hits.
DISTANCE_SLACK = 1e-3

LATENCY_PERCENTS = [50, 95, 99]


def ground_truth(base: DataFrame, queries: DataFrame, k: int, **columns) -> DataFrame:
    """Exact neighbours, for data that ships without a ground-truth file."""
    return knn_batch(base, queries, k, **columns)


def truth_lists(truth: DataFrame) -> DataFrame:
    """Ground truth in file shape: ``(query_index, neighbors)`` in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct("rk", "id")))
    return truth.groupBy("query_index").agg(pairs.alias("pairs")).select(
        "query_index", F.col("pairs.id").alias("neighbors")
    )


def truth_rows(lists: DataFrame) -> DataFrame:
    """Long form of :func:`truth_lists` (or of an ``ivecs`` file)."""
    return lists.select("query_index", F.posexplode("neighbors").alias("pos", "id")).select(
        "query_index", (F.col("pos") + 1).alias("rk"), "id"
    )


def id_hits(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Common ids of the first ``k`` on both sides: ``(query_index, id_hits)``."""
    returned = results.where(F.col("rk") <= k).select("query_index", "id", F.lit(1).alias("hit"))
    expected = truth.where(F.col("rk") <= k).select("query_index", "id")
    return (
        expected.join(returned, ["query_index", "id"], "left")
        .groupBy("query_index")
        .agg(F.count("hit").alias("id_hits"))
    )


def vectors_of(ids: DataFrame, base: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Base vectors for the ``id`` column of ``ids``; ids outside the base drop out."""
    rows = base.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"))
    return rows.join(ids, "id")


def unknown_ids(ids: DataFrame, id_base: int, rows: int) -> DataFrame:
    """Ids outside ``id_base .. id_base+rows-1``."""
    return ids.where(~F.col("id").between(id_base, id_base + rows - 1))


def recompute_distances(results: DataFrame, queries: DataFrame, base: DataFrame, **columns) -> DataFrame:
    """Distances of returned ids, computed from the stored vectors."""
    ids = results.select("query_index", "rk", "id")
    found = vectors_of(ids, base, **columns).join(
        queries.select("query_index", "qvec"), "query_index"
    )
    return found.select(
        "query_index", "rk", "id", l2_distance_batch("embedding", "qvec").alias("dist")
    )


def distance_thresholds(truth: DataFrame, queries: DataFrame, base: DataFrame, k: int, **columns) -> DataFrame:
    """Distance to the k-th true neighbour plus slack: ``(query_index, threshold)``."""
    kth = truth.where(F.col("rk") == k)
    found = recompute_distances(kth, queries, base, **columns)
    return found.select("query_index", (F.col("dist") + DISTANCE_SLACK).alias("threshold"))


def distance_hits(results: DataFrame, thresholds: DataFrame, k: int) -> DataFrame:
    """Returned rows within their query's threshold: ``(query_index, distance_hits)``."""
    returned = results.where(F.col("rk") <= k).select("query_index", "dist")
    return (
        thresholds.join(returned, "query_index", "left")
        .groupBy("query_index")
        .agg(F.count_if(F.col("dist") <= F.col("threshold")).alias("distance_hits"))
    )


def recall_by_k(
    results: DataFrame,
    truth: DataFrame,
    thresholds: DataFrame,
    ks: list[int],
    query_count: int,
    gt_width: int | None = None,
) -> DataFrame:
    """Both recalls for every ``k`` from one result set that holds the largest ``k``.

    Thresholds are ``(query_index, k, threshold)``. Hits are divided by ``query_count * k``.
    Beyond the width of the ground truth the metrics are NULL.
    """
    named = results.withColumn("engine", F.lit("one"))
    return recall_by_engine(named, truth, thresholds, ["one"], ks, query_count, gt_width).drop("engine")


def recall_by_engine(
    results: DataFrame,
    truth: DataFrame,
    thresholds: DataFrame,
    engines: list[str],
    ks: list[int],
    query_count: int,
    gt_width: int | None = None,
) -> DataFrame:
    """:func:`recall_by_k` of several engines, told apart by the column ``engine`` of ``results``.

    All engines and all ``k`` come from one pass: ground truth and thresholds are joined once to the union
    of the results. An engine of ``engines`` without results has no hits.
    """
    spark = results.sparkSession
    if any(not 1 <= k <= MAX_K for k in ks):
        raise ValueError(f"every k must lie in 1..{MAX_K}")
    axis = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    returned = results.select("engine", "query_index", "rk", "id", "dist", axis).where(F.col("rk") <= F.col("k"))
    expected = truth.select("query_index", F.col("rk").alias("true_rk"), "id")
    scored = (
        returned.join(expected, ["query_index", "id"], "left")
        .join(thresholds, ["query_index", "k"], "left")
        .groupBy("engine", "k")
        .agg(
            F.count_if(F.col("true_rk") <= F.col("k")).alias("id_hits"),
            F.count_if(F.col("dist") <= F.col("threshold")).alias("distance_hits"),
        )
    )
    grid = spark.createDataFrame(
        [(e, k, query_count * k) for e in engines for k in ks], "engine string, k int, possible_hits long"
    )
    joined = grid.join(scored, ["engine", "k"], "left")
    width = gt_width if gt_width is not None else max(ks)

    def known(column: Column) -> Column:
        return F.when(F.col("k") <= width, F.coalesce(column, F.lit(0)))

    hits, near = known(F.col("id_hits")), known(F.col("distance_hits"))
    possible = F.when(F.col("k") <= width, F.col("possible_hits"))
    return joined.select(
        "engine",
        "k",
        hits.alias("id_hits"),
        near.alias("distance_hits"),
        possible.alias("possible_hits"),
        (hits / possible).alias("recall_id"),
        (near / possible).alias("recall_distance"),
    )


def thresholds_by_k(truth: DataFrame, queries: DataFrame, base: DataFrame, ks: list[int], **columns) -> DataFrame:
    """Thresholds for several ``k`` in one scan of the base."""
    kth = truth.where(F.col("rk").isin(ks))
    found = recompute_distances(kth, queries, base, **columns)
    return found.select(
        "query_index", F.col("rk").alias("k"), (F.col("dist") + DISTANCE_SLACK).alias("threshold")
    )


def timed_only(timings: DataFrame, warmup: int, query_count: int) -> DataFrame:
    """Drop the warm-up statements: the first ``min(warmup, query_count)`` of every run."""
    if warmup < 0:
        raise ValueError("warmup must not be negative")
    return timings.where(F.col("statement_no") >= min(warmup, query_count))


def without_warmup(timings: DataFrame, run: list[str], order: str, warmup: int) -> DataFrame:
    """Same for statements that carry no number: drop the first ``warmup`` of every run.

    Exactly ``warmup`` rows of a run go, also where order values are tied or NULL (NULL first).
    The last order value that goes and the number of its rows that go are found from counts
    per value; only rows tied with it are numbered.
    """
    if warmup < 0:
        raise ValueError("warmup must not be negative")
    if warmup == 0:
        return timings
    # At most ``warmup`` order values per run can matter; the rest is cut before the shuffle.
    counts = timings.groupBy(*run, order).agg(F.count("*").alias("__n"))
    rank = W.partitionBy(*run).orderBy(F.col(order).asc_nulls_first())
    first = counts.withColumn("__rk", F.row_number().over(rank)).where(F.col("__rk") <= warmup)
    upto = F.sum("__n").over(rank.rowsBetween(W.unboundedPreceding, 0))
    cut = first.withColumn("__left", F.lit(warmup) - (upto - F.col("__n"))).where(F.col("__left") > 0)
    marked = join_null_safe(timings, cut.select(*run, order, "__n", "__left"), [*run, order], "left")
    whole = F.col("__left") >= F.col("__n")
    kept = marked.where(F.col("__left").isNull()).select(*timings.columns)
    tied = marked.where(~whole)
    number = F.row_number().over(W.partitionBy(*run, order).orderBy(*tied.columns))
    some = tied.withColumn("__at", number).where(F.col("__at") > F.col("__left"))
    return kept.unionByName(some.select(*timings.columns))


def latency_summary(timings: DataFrame, group: list[str], value: str = "elapsed_ms") -> DataFrame:
    """Sum, mean, percentiles, extremes and throughput per group.

    Throughput is queries per second of summed statement time.
    """
    basics = {
        "queries": "count(v)", "sum_ms": "sum(v)", "mean_ms": "avg(v)", "min_ms": "min(v)", "max_ms": "max(v)",
    }
    summary = percentile_table(timings, group, value, LATENCY_PERCENTS, basics)
    return summary.withColumn("qps", F.col("queries") / (F.col("sum_ms") / 1000.0))


def scenario_grid(
    spark: SparkSession, modes: list[str], ks: list[int], dops: list[int], rounds: int
) -> DataFrame:
    """Every mode x k x parallel degree x round, with its label."""
    unknown = [m for m in modes if m not in ("index", "fullscan")]
    if unknown:
        raise ValueError(f"unknown mode {unknown[0]!r}; use index or fullscan")
    if rounds < 1:
        raise ValueError("rounds must be positive")
    axes = {"mode": modes, "k": ks, "dop": dops, "round": list(range(1, rounds + 1))}
    grid = spark.range(1)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    label = scenario_label("mode", "k", "dop", "round")
    return grid.select("mode", "k", "dop", "round", label.alias("label"))


def round_variation(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Spread of each metric over the rounds of a scenario."""
    spread = []
    for name in metrics:
        spread += [
            F.avg(name).alias(f"{name}_mean"),
            F.stddev_samp(name).alias(f"{name}_stddev"),
            F.min(name).alias(f"{name}_min"),
            F.max(name).alias(f"{name}_max"),
        ]
    return runs.groupBy("mode", "k", "dop").agg(F.count("*").alias("rounds"), *spread)


def speedup(runs: DataFrame, metric: str = "mean_ms") -> DataFrame:
    """Full-scan time over index time per (k, dop)."""
    table = runs.groupBy("k", "dop").pivot("mode", ["index", "fullscan"]).agg(F.avg(metric))
    return table.withColumn("speedup", F.col("fullscan") / F.col("index"))


def scenario_documents(summary: DataFrame, per_query: DataFrame, key: str = "label") -> DataFrame:
    """One nested row per scenario: scalars, a struct of times and the per-query array.

    ``per_query`` has at most one row per query and scenario, so the array is bounded by the
    number of benchmark queries.
    """
    timing = ["sum_ms", "mean_ms", "p50", "p95", "p99", "min_ms", "max_ms"]
    present = [c for c in timing if c in summary.columns]
    scalars = [c for c in summary.columns if c not in present]
    rows = F.array_sort(
        F.collect_list(F.struct(*[c for c in per_query.columns if c != key]))
    ).alias("per_query")
    nested = summary.select(*scalars, F.struct(*present).alias("query_time_ms"))
    return nested.join(per_query.groupBy(key).agg(rows), key, "left")


def counts_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """Gate: queries and ground truth must have equally many rows (empty result = pass)."""
    a = left.agg(F.count("*").alias("left_rows"))
    b = right.agg(F.count("*").alias("right_rows"))
    both = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")
    return both.where(F.col("left_rows") != F.col("right_rows"))


def below_gate(metrics: DataFrame, column: str, required: float) -> DataFrame:
    """Scenarios whose metric misses the required value (empty result = pass)."""
    return metrics.where(F.col(column).isNull() | (F.col(column) < required))
