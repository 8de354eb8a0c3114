"""Recall, latency, scenario matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.operators import evaluate
from vectorloom.operators.exact import knn_batch, knn_blocks
from vectorloom.operators.percentiles import percentile_table
from vectorloom.suite.base import EXACT_CTE, K, all_queries, query, table, vectors
from vectorloom.suite.index import IVF_CTE, PQ_CTE, adc_cte, ivf_index, ivf_search_cte, pq_index
from vectorloom.operators.ivf import search_ivf
from vectorloom.operators.pq import search_pq
from vectorloom.plans import matrix
from vectorloom.session import materialize, new_workdir

KS = [1, 5, 10]


def searched(spark, sf_dir, nprobe=4):
    """Index search, written once: a metric reads its result several times."""
    found = search_ivf(ivf_index(spark, sf_dir), all_queries(spark, sf_dir), K, nprobe)
    return materialize(found, "found")


def truth(spark, sf_dir):
    """Ground truth, written once like the ground-truth file of a dataset."""
    return materialize(knn_batch(vectors(spark, sf_dir), all_queries(spark, sf_dir), K), "truth")


RECALL_CTE = f"""
WITH {EXACT_CTE}, {IVF_CTE}, {ivf_search_cte(4)},
hits AS (
  SELECT x.query_index, count(f.id) AS id_hits
  FROM exact x LEFT JOIN found f ON f.query_index = x.query_index AND f.id = x.id
  GROUP BY x.query_index),
thr AS (SELECT query_index, rk AS k, dist + 1e-3 AS threshold FROM exact)
"""


@query("recall_id", RECALL_CTE + "SELECT query_index, id_hits FROM hits")
def recall_id(spark, sf_dir):
    return evaluate.id_hits(searched(spark, sf_dir), truth(spark, sf_dir), K)


@query(
    "recall_distance",
    RECALL_CTE
    + """
    SELECT t.query_index, count(f.id) FILTER (WHERE f.dist <= t.threshold) AS distance_hits
    FROM thr t LEFT JOIN found f ON f.query_index = t.query_index
    WHERE t.k = 10 GROUP BY t.query_index
    """,
)
def recall_distance(spark, sf_dir):
    base, queries = vectors(spark, sf_dir), all_queries(spark, sf_dir)
    limits = evaluate.distance_thresholds(truth(spark, sf_dir), queries, base, K)
    results = evaluate.recompute_distances(searched(spark, sf_dir), queries, base)
    return evaluate.distance_hits(results, limits, K)


@query(
    "recall_by_k",
    RECALL_CTE
    + """
    , total AS (SELECT count(*) AS nq FROM e)
    SELECT k.k, count(x.id) AS id_hits,
           count(*) FILTER (WHERE f.dist <= t.threshold) AS distance_hits,
           k.k * any_value(nq) AS possible_hits,
           round(count(x.id) / (k.k * any_value(nq)), 6) AS recall_id,
           round(count(*) FILTER (WHERE f.dist <= t.threshold) / (k.k * any_value(nq)), 6) AS recall_distance
    FROM (VALUES (1), (5), (10)) k(k)
    JOIN found f ON f.rk <= k.k
    JOIN total ON true
    LEFT JOIN exact x ON x.query_index = f.query_index AND x.id = f.id AND x.rk <= k.k
    LEFT JOIN thr t ON t.query_index = f.query_index AND t.k = k.k
    GROUP BY k.k
    """,
)
def recall_by_k(spark, sf_dir):
    """All k from one search of the largest k."""
    base, queries = vectors(spark, sf_dir), all_queries(spark, sf_dir)
    expected = truth(spark, sf_dir)
    limits = evaluate.thresholds_by_k(expected, queries, base, KS)
    scored = evaluate.recall_by_k(searched(spark, sf_dir), expected, limits, KS, base.count())
    return scored.select(
        "k",
        "id_hits",
        "distance_hits",
        "possible_hits",
        F.round("recall_id", 6).alias("recall_id"),
        F.round("recall_distance", 6).alias("recall_distance"),
    )


@query(
    "recall_skipped_beyond_truth",
    RECALL_CTE
    + """
    , total AS (SELECT count(*) AS nq FROM e)
    SELECT k.k, CASE WHEN k.k <= 5 THEN count(x.id) END AS id_hits,
           CASE WHEN k.k <= 5 THEN k.k * any_value(nq) END AS possible_hits
    FROM (VALUES (1), (5), (10)) k(k)
    JOIN found f ON f.rk <= k.k
    JOIN total ON true
    LEFT JOIN exact x ON x.query_index = f.query_index AND x.id = f.id AND x.rk <= k.k
    GROUP BY k.k
    """,
)
def recall_skipped(spark, sf_dir):
    """A k above the ground-truth width has no recall."""
    base, queries = vectors(spark, sf_dir), all_queries(spark, sf_dir)
    expected = truth(spark, sf_dir)
    limits = evaluate.thresholds_by_k(expected, queries, base, [1, 5])
    scored = evaluate.recall_by_k(
        searched(spark, sf_dir), expected, limits, KS, base.count(), gt_width=5
    )
    return scored.select("k", "id_hits", "possible_hits")


def gate(spark, sf_dir, results):
    """Scenarios of ``results`` below distance recall 1.0 against the ground truth."""
    base, queries = vectors(spark, sf_dir), all_queries(spark, sf_dir)
    expected = truth(spark, sf_dir)
    limits = evaluate.thresholds_by_k(expected, queries, base, KS)
    scored = evaluate.recall_by_k(results, expected, limits, KS, base.count())
    return evaluate.below_gate(scored, "recall_distance", 1.0).select("k", "recall_distance")


def joined_search(spark, sf_dir):
    """A full scan by the block join, which shares no step with the scan behind the ground truth."""
    return knn_blocks(vectors(spark, sf_dir), all_queries(spark, sf_dir), K)


@query(
    "fullscan_gate",
    "SELECT CAST(NULL AS INT) AS k, CAST(NULL AS DOUBLE) AS recall_distance FROM embeddings WHERE false",
)
def fullscan_gate(spark, sf_dir):
    """Full scan must reach distance recall 1.0: no scenario may miss it."""
    return gate(spark, sf_dir, joined_search(spark, sf_dir))


@query(
    "fullscan_gate_misses",
    """
    SELECT CAST(k AS INT) AS k, (n * k - m) / (n * k) AS recall_distance
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 7 = 0) AS m FROM embeddings), (VALUES (1), (5), (10)) v(k)
    """,
)
def fullscan_gate_misses(spark, sf_dir):
    """The same search without the nearest row of every seventh query: the gate must see it."""
    found = joined_search(spark, sf_dir)
    lost = (F.col("query_index") % 7 == 0) & (F.col("rk") == 1)
    return gate(spark, sf_dir, found.where(~lost))


def timings(spark, sf_dir):
    """Event values as statement times, one run per event type."""
    return table(spark, sf_dir, "events").select(
        "event_type", F.col("event_id").alias("query_index"), F.col("value").alias("elapsed_ms")
    )


LATENCY_SQL = """
SELECT event_type, count(*) AS queries, round(sum(value), 4) AS sum_ms, round(avg(value), 6) AS mean_ms,
       min(value) AS min_ms, max(value) AS max_ms,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
       round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) / (sum(value) / 1000.0), 6) AS qps
FROM events GROUP BY event_type
"""


def rounded_latency(summary):
    six = ["mean_ms", "p50", "p95", "p99", "qps"]
    return summary.select(
        "event_type",
        "queries",
        F.round("sum_ms", 4).alias("sum_ms"),
        "min_ms",
        "max_ms",
        *[F.round(c, 6).alias(c) for c in six],
    )


@query("latency_summary", LATENCY_SQL)
def latency_summary(spark, sf_dir):
    return rounded_latency(evaluate.latency_summary(timings(spark, sf_dir), ["event_type"]))


@query("latency_summary_ranked", LATENCY_SQL)
def latency_summary_ranked(spark, sf_dir):
    """Same summary on the path for groups too large for one task."""
    summary = evaluate.latency_summary(timings(spark, sf_dir), ["event_type"])
    return rounded_latency(summary)


@query(
    "latency_hot_and_null_groups",
    LATENCY_SQL.replace("SELECT event_type,", "SELECT g AS event_type,").replace(
        "FROM events GROUP BY event_type",
        "FROM (SELECT *, CASE WHEN user_id % 20 = 0 THEN NULL WHEN user_id % 20 = 1 THEN event_type ELSE 'hot' END AS g FROM events) GROUP BY g",
    ),
)
def latency_hot_and_null_groups(spark, sf_dir):
    """Nine tenths of the rows in one group, a group without a name, and small ones beside them."""
    user = F.col("user_id") % 20
    rows = table(spark, sf_dir, "events").select(
        F.when(user == 0, F.lit(None)).when(user == 1, F.col("event_type")).otherwise("hot").alias("event_type"),
        F.col("value").alias("elapsed_ms"),
    )
    return rounded_latency(evaluate.latency_summary(rows, ["event_type"]))


@query(
    "latency_percentiles_by_user",
    """
    SELECT user_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY user_id
    """,
)
def percentiles_by_user(spark, sf_dir):
    cuts = percentile_table(table(spark, sf_dir, "events"), ["user_id"], "value", [50, 99])
    return cuts.select("user_id", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@query(
    "warmup_excluded",
    """
    WITH t AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS statement_no FROM events)
    SELECT user_id, count(*) AS queries, round(avg(value), 6) AS mean_ms FROM t WHERE statement_no >= 5 GROUP BY user_id
    """,
)
def warmup_excluded(spark, sf_dir):
    """The first five statements of a run only warm up."""
    timed = evaluate.without_warmup(table(spark, sf_dir, "events"), ["user_id"], "event_id", 5)
    return timed.groupBy("user_id").agg(
        F.count("*").alias("queries"), F.round(F.avg("value"), 6).alias("mean_ms")
    )


@query(
    "per_query_rows",
    RECALL_CTE
    + """
    SELECT f.query_index, v.value AS elapsed_ms, any_value(h.id_hits) AS id_hits,
           count(*) FILTER (WHERE f.dist <= t.threshold) AS distance_hits,
           string_agg(CAST(f.id AS VARCHAR), ',' ORDER BY f.rk) AS returned_ids
    FROM found f JOIN hits h ON h.query_index = f.query_index
    JOIN thr t ON t.query_index = f.query_index AND t.k = 10
    JOIN events v ON v.event_id = f.query_index
    GROUP BY f.query_index, v.value
    """,
)
def per_query_rows(spark, sf_dir):
    """Results, hits and times of a scenario aligned by query."""
    base, queries = vectors(spark, sf_dir), all_queries(spark, sf_dir)
    found, expected = searched(spark, sf_dir), truth(spark, sf_dir)
    limits = evaluate.distance_thresholds(expected, queries, base, K)
    lists = evaluate.truth_lists(found).select(
        "query_index", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("returned_ids")
    )
    times = timings(spark, sf_dir).select("query_index", "elapsed_ms")
    return (
        lists.join(evaluate.id_hits(found, expected, K), "query_index")
        .join(evaluate.distance_hits(found, limits, K), "query_index")
        .join(times, "query_index")
        .select("query_index", "elapsed_ms", "id_hits", "distance_hits", "returned_ids")
    )


@query(
    "scenario_matrix",
    RECALL_CTE
    + """
    , modes AS (
      SELECT 'index' AS mode, query_index, rk, id, dist FROM found
      UNION ALL SELECT 'fullscan', query_index, rk, id, dist FROM exact),
    g AS (SELECT mode, k.k, dop.dop, CAST(r.r AS INT) AS round
          FROM (VALUES ('index'), ('fullscan')) m(mode), (VALUES (1), (5), (10)) k(k),
               (VALUES (1), (8)) dop(dop), range(1, 3) r(r)),
    s AS (
      SELECT m.mode, k.k, count(x.id) AS id_hits
      FROM (VALUES (1), (5), (10)) k(k) JOIN modes m ON m.rk <= k.k
      LEFT JOIN exact x ON x.query_index = m.query_index AND x.id = m.id AND x.rk <= k.k
      GROUP BY m.mode, k.k)
    SELECT concat(g.mode, '-k', g.k, '-dop', g.dop, '-r', g.round) AS label, g.k, g.dop, g.round, s.id_hits
    FROM g JOIN s ON s.mode = g.mode AND s.k = g.k
    """,
)
def scenario_matrix(spark, sf_dir):
    """Grid of scenarios, every k scored from one search per mode."""
    base, queries = vectors(spark, sf_dir), all_queries(spark, sf_dir)
    expected, total = truth(spark, sf_dir), base.count()
    limits = evaluate.thresholds_by_k(expected, queries, base, KS)
    scores = None
    for mode, results in (("index", searched(spark, sf_dir)), ("fullscan", expected)):
        part = evaluate.recall_by_k(results, expected, limits, KS, total).withColumn("mode", F.lit(mode))
        scores = part if scores is None else scores.unionByName(part)
    grid = evaluate.scenario_grid(spark, ["index", "fullscan"], KS, [1, 8], 2)
    return grid.join(scores, ["mode", "k"]).select("label", "k", "dop", "round", "id_hits")


# Results of the three engines, one pool of 50 candidates a query for the codes.
ENGINES_CTE = (
    RECALL_CTE
    + f"""
, {PQ_CTE}, {adc_cte(4).replace("probes AS", "code_probes AS").replace("FROM probes p", "FROM code_probes p")},
pool AS MATERIALIZED (
  SELECT query_index, id FROM (
    SELECT query_index, id, row_number() OVER (PARTITION BY query_index ORDER BY adc, id) AS r FROM adc) WHERE r <= 50),
reranked AS MATERIALIZED (
  SELECT * FROM (
    SELECT p.query_index, p.id, list_distance(q.v, b.v) AS dist, row_number() OVER (
      PARTITION BY p.query_index ORDER BY list_distance(q.v, b.v), p.id) AS rk
    FROM pool p JOIN e q ON q.id = p.query_index JOIN e b ON b.id = p.id) WHERE rk <= 10),
engines AS (
  SELECT 'flat' AS engine, query_index, rk, id, dist FROM found
  UNION ALL SELECT 'pq', query_index, rk, id, dist FROM reranked
  UNION ALL SELECT 'fullscan', query_index, rk, id, dist FROM exact),
scores AS (
  SELECT f.engine, k.k, count(x.id) AS id_hits, count(*) FILTER (WHERE f.dist <= t.threshold) AS distance_hits,
         k.k * (SELECT count(*) FROM e) AS possible_hits
  FROM (VALUES (1), (5), (10)) k(k) JOIN engines f ON f.rk <= k.k
  LEFT JOIN exact x ON x.query_index = f.query_index AND x.id = f.id AND x.rk <= k.k
  LEFT JOIN thr t ON t.query_index = f.query_index AND t.k = k.k
  GROUP BY f.engine, k.k)
"""
)


def engine_scores(spark, sf_dir):
    base, queries = vectors(spark, sf_dir), all_queries(spark, sf_dir)
    data = matrix.Dataset(base, queries, base.count(), K)
    searches = {
        "flat": search_ivf(ivf_index(spark, sf_dir), queries, K, 4),
        "pq": search_pq(pq_index(spark, sf_dir), queries, K, 4),
        "fullscan": knn_batch(base, queries, K),
    }
    return matrix.score_engines(data, searches, KS, truth(spark, sf_dir))


@query(
    "representative_suite",
    ENGINES_CTE
    + """
    SELECT engine, k, id_hits, distance_hits, possible_hits, round(id_hits / possible_hits, 6) AS recall_id,
           round(distance_hits / possible_hits, 6) AS recall_distance FROM scores
    """,
)
def representative_suite(spark, sf_dir):
    """Lists, codes and full scan, every k of every engine scored in one pass over the union of their results."""
    found = engine_scores(spark, sf_dir)
    return found.withColumns({c: F.round(c, 6) for c in ("recall_id", "recall_distance")})


@query(
    "matrix_summary",
    ENGINES_CTE
    + """
    SELECT 9 AS total, 'flat,fullscan,pq' AS engines, '1,5,10' AS ks, row_number() OVER (ORDER BY engine, k) AS place,
           engine, k, id_hits FROM scores
    """,
)
def matrix_summary(spark, sf_dir):
    """The summary document of a matrix, axes and scenario list, written as JSON and read back."""
    path = new_workdir(spark, "matrix")
    matrix.write_matrix_summary(engine_scores(spark, sf_dir), ["engine", "k"], path)
    document = spark.read.json(path)
    listed = document.select(
        F.col("total").cast("int").alias("total"),
        F.array_join("axes.engine", ",").alias("engines"),
        F.array_join(F.transform("axes.k", lambda k: k.cast("string")), ",").alias("ks"),
        F.posexplode("scenarios").alias("pos", "s"),
    )
    return listed.select(
        "total", "engines", "ks", (F.col("pos") + 1).cast("long").alias("place"), "s.engine",
        F.col("s.k").cast("int").alias("k"), "s.id_hits",
    )


def runs(spark, sf_dir):
    """Events as scenario runs: mode, k, dop and a measured time."""
    mode = F.when(F.col("event_type").isin("view", "purchase"), "index").otherwise("fullscan")
    return table(spark, sf_dir, "events").select(
        mode.alias("mode"),
        (F.col("user_id") % 3).alias("k"),
        (F.col("event_id") % 4).alias("dop"),
        F.col("value").alias("mean_ms"),
    )


RUNS_CTE = """
WITH r AS (
  SELECT CASE WHEN event_type IN ('view', 'purchase') THEN 'index' ELSE 'fullscan' END AS mode,
         user_id % 3 AS k, event_id % 4 AS dop, value AS mean_ms FROM events)
"""


@query(
    "round_variation",
    RUNS_CTE
    + """
    SELECT mode, k, dop, count(*) AS rounds, round(avg(mean_ms), 6) AS mean_ms_mean,
           round(stddev_samp(mean_ms), 6) AS mean_ms_stddev, min(mean_ms) AS mean_ms_min, max(mean_ms) AS mean_ms_max
    FROM r GROUP BY mode, k, dop
    """,
)
def round_variation(spark, sf_dir):
    spread = evaluate.round_variation(runs(spark, sf_dir), ["mean_ms"])
    return spread.withColumns(
        {c: F.round(c, 6) for c in ("mean_ms_mean", "mean_ms_stddev")}
    )


@query(
    "speedup_pivot",
    RUNS_CTE
    + """
    SELECT k, dop, round(avg(mean_ms) FILTER (WHERE mode = 'index'), 6) AS index_ms,
           round(avg(mean_ms) FILTER (WHERE mode = 'fullscan'), 6) AS fullscan_ms,
           round(avg(mean_ms) FILTER (WHERE mode = 'fullscan') / avg(mean_ms) FILTER (WHERE mode = 'index'), 6) AS speedup
    FROM r GROUP BY k, dop
    """,
)
def speedup_pivot(spark, sf_dir):
    wide = evaluate.speedup(runs(spark, sf_dir))
    return wide.select(
        "k",
        "dop",
        F.round("index", 6).alias("index_ms"),
        F.round("fullscan", 6).alias("fullscan_ms"),
        F.round("speedup", 6).alias("speedup"),
    )


@query(
    "scenario_documents",
    """
    SELECT concat(event_type, '-', event_id // 1000) AS label, count(*) AS queries, max(value) AS slowest,
           count(*) AS per_query_rows, min(event_id) AS first_query
    FROM events GROUP BY 1
    """,
)
def scenario_documents(spark, sf_dir):
    """Nested result documents written as JSON and read back.

    A scenario is an event type within one run of 1000 event ids, so its per-query array has
    at most 1000 entries whatever the skew.
    """
    from vectorloom.sources.metadata import read_results

    run = F.expr("event_id div 1000")
    rows = table(spark, sf_dir, "events").select(
        F.concat_ws("-", "event_type", run).alias("label"),
        F.col("event_id").alias("query_index"),
        F.col("value").alias("elapsed_ms"),
    )
    summary = evaluate.latency_summary(rows, ["label"])
    path = new_workdir(spark, "scenarios")
    evaluate.scenario_documents(summary, rows).write.json(path)
    read = read_results(spark, path, one_per_file=False)
    return read.select(
        "label",
        "queries",
        F.col("query_time_ms.max_ms").alias("slowest"),
        F.size("per_query").cast("long").alias("per_query_rows"),
        F.array_min(F.col("per_query.query_index")).alias("first_query"),
    )


@query(
    "truth_cardinality",
    """
    SELECT a.n AS left_rows, b.n AS right_rows
    FROM (SELECT count(*) AS n FROM documents) a, (SELECT count(*) AS n FROM labels) b WHERE a.n <> b.n
    """,
)
def truth_cardinality(spark, sf_dir):
    """Gate on equal row counts, on two tables that differ."""
    return evaluate.counts_differ(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
