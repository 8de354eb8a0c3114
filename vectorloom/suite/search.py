"""Exact search, sampling and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.functions.sampling import sample_position
from vectorloom.functions.sql import register_functions
from vectorloom.functions.vector import l2_distance, parse_vector, squared_l2, subvector, vector_literal
from vectorloom.operators import exact
from vectorloom.operators.evaluate import ground_truth, truth_lists, truth_rows
from vectorloom.operators.topk import cap_per_worker, fetch_k_column
from vectorloom.functions.bucket import with_bucket
from vectorloom.suite.base import EXACT_CTE, K, all_queries, neighbours, query, table, vectors

NEIGHBOUR_SQL = f"""
WITH {EXACT_CTE}
SELECT query_index, rk, id, round(dist, 6) AS dist FROM exact
"""


@query(
    "knn_single",
    """
    WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    q AS (SELECT v AS qv FROM e ORDER BY id LIMIT 1)
    SELECT id, round(list_distance(v, qv), 6) AS dist FROM e, q
    ORDER BY list_distance(v, qv), id LIMIT 10
    """,
)
def knn_single(spark, sf_dir):
    base = vectors(spark, sf_dir)
    vector = base.orderBy("id").select("embedding").head().embedding
    found = exact.knn_single(base, vector, K)
    return found.select("id", F.round("dist", 6).alias("dist"))


@query(
    "knn_statement",
    """
    WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    q AS (SELECT v AS qv FROM e ORDER BY id DESC LIMIT 1)
    SELECT id FROM e, q ORDER BY list_distance(v, qv), id LIMIT 10
    """,
)
def knn_statement(spark, sf_dir):
    """The search as one SQL statement: distance to a vector literal, ordered, limited, ids only."""
    register_functions(spark)
    base = vectors(spark, sf_dir)
    base.createOrReplaceTempView("suite_vectors")
    literal = base.orderBy(F.desc("id")).select(vector_literal("embedding").alias("t")).head().t
    return spark.sql(
        f"""
        SELECT id FROM (SELECT id, l2_distance(embedding, vec_parse('{literal}')) AS dist FROM suite_vectors)
        ORDER BY dist, id LIMIT {K}
        """
    )


@query("knn_batch", NEIGHBOUR_SQL)
def knn_batch(spark, sf_dir):
    return neighbours(exact.knn_batch(vectors(spark, sf_dir), all_queries(spark, sf_dir), K))


@query("knn_batch_ceiling", NEIGHBOUR_SQL)
def knn_batch_ceiling(spark, sf_dir):
    """Same search after bounding each query's k-th distance from a subset."""
    base = vectors(spark, sf_dir)
    probe = base.where(F.pmod(F.xxhash64("id"), F.lit(4)) == 0)
    return neighbours(exact.knn_batch(base, all_queries(spark, sf_dir), K, probe=probe))


@query("knn_blocks", NEIGHBOUR_SQL)
def knn_blocks(spark, sf_dir):
    return neighbours(exact.knn_blocks(vectors(spark, sf_dir), all_queries(spark, sf_dir), K))


@query("fullscan_search", NEIGHBOUR_SQL)
def fullscan_search(spark, sf_dir):
    from vectorloom.operators.ivf import search

    return neighbours(
        search("fullscan", all_queries(spark, sf_dir), K, base=vectors(spark, sf_dir))
    )


RADIUS = 1.15
RADIUS_SQL = f"""
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT q.id AS query_index, b.id AS id, round(list_distance(q.v, b.v), 6) AS dist
FROM e q JOIN e b ON list_distance(q.v, b.v) <= {RADIUS}
"""


@query("knn_radius", RADIUS_SQL)
def knn_radius(spark, sf_dir):
    found = exact.radius_search(vectors(spark, sf_dir), all_queries(spark, sf_dir), RADIUS)
    return found.select("query_index", "id", F.round("dist", 6).alias("dist"))


@query("knn_radius_blocks", RADIUS_SQL)
def knn_radius_blocks(spark, sf_dir):
    found = exact.radius_blocks(vectors(spark, sf_dir), all_queries(spark, sf_dir), RADIUS)
    return found.select("query_index", "id", F.round("dist", 6).alias("dist"))


@query("ground_truth", NEIGHBOUR_SQL.replace(", round(dist, 6) AS dist", ""))
def truth(spark, sf_dir):
    """Ground truth to file shape (one list per query) and back to rows."""
    found = ground_truth(vectors(spark, sf_dir), all_queries(spark, sf_dir), K)
    return truth_rows(truth_lists(found)).select(
        "query_index", F.col("rk").cast("long").alias("rk"), "id"
    )


@query(
    "worker_candidates",
    f"""
    WITH {EXACT_CTE},
    b AS (SELECT exact.*, id % 4 AS worker FROM exact)
    SELECT query_index, worker, worker_rk, id FROM (
      SELECT *, row_number() OVER (PARTITION BY query_index, worker ORDER BY dist, id) AS worker_rk
      FROM b) WHERE worker_rk <= 2
    """,
)
def worker_candidates(spark, sf_dir):
    found = exact.knn_batch(vectors(spark, sf_dir), all_queries(spark, sf_dir), K)
    owned = found.withColumn("worker", F.col("id") % 4)
    kept = cap_per_worker(owned, 2, dist="dist")
    return kept.select("query_index", "worker", F.col("worker_rk").cast("long").alias("worker_rk"), "id")


def sampled(spark, sf_dir, sampling, count):
    base = vectors(spark, sf_dir)
    total = base.count()
    position = sample_position("id", total, count, sampling)
    return (
        base.select("id", position.alias("position"), F.size("embedding").cast("long").alias("dim"))
        .where(F.col("position").isNotNull())
    )


@query(
    "sample_first",
    """
    SELECT vec_id AS id, vec_id AS position, len(embedding) AS dim FROM embeddings WHERE vec_id < 100
    """,
)
def sample_first(spark, sf_dir):
    return sampled(spark, sf_dir, "first", 100)


@query(
    "sample_equidistant",
    """
    WITH n AS (SELECT count(*) AS n FROM embeddings),
    s AS (SELECT i AS position, (i * (n - 1)) // 99 AS id FROM range(100) t(i), n)
    SELECT s.id, s.position, len(embedding) AS dim FROM s JOIN embeddings ON vec_id = s.id
    """,
)
def sample_equidistant(spark, sf_dir):
    return sampled(spark, sf_dir, "equidistant", 100)


@query(
    "sample_aligned",
    f"""
    WITH {EXACT_CTE},
    n AS (SELECT count(*) AS n FROM embeddings),
    s AS (SELECT i AS position, (i * (n - 1)) // 49 AS query_index FROM range(50) t(i), n)
    SELECT s.position, s.query_index, exact.rk, exact.id FROM s JOIN exact USING (query_index)
    """,
)
def sample_aligned(spark, sf_dir):
    """The same ordinals select queries and their ground truth."""
    base = vectors(spark, sf_dir)
    total = base.count()
    position = sample_position("query_index", total, 50, "equidistant")
    chosen = (
        all_queries(spark, sf_dir)
        .withColumn("position", position)
        .where(F.col("position").isNotNull())
    )
    truth = exact.knn_batch(base, chosen, K)
    return truth.join(chosen.select("query_index", "position"), "query_index").select(
        "position", "query_index", F.col("rk").cast("long").alias("rk"), "id"
    )


@query(
    "l2_expressions",
    """
    WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    c AS (SELECT label, v AS cv FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) = 1)
    SELECT id, round(list_distance(v, cv), 6) AS dist,
           round(pow(list_distance(v, cv), 2), 6) AS squared,
           round(pow(list_distance(v[9:16], cv[9:16]), 2), 6) AS part_squared
    FROM e JOIN c USING (label)
    """,
)
def l2_expressions(spark, sf_dir):
    """Distance of every vector to the first one of its label, as built-in expressions."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    first = rows.groupBy("label").agg(F.min_by("embedding", "id").alias("center"))
    joined = rows.join(first, "label")
    return joined.select(
        "id",
        F.round(l2_distance("embedding", "center"), 6).alias("dist"),
        F.round(squared_l2("embedding", "center"), 6).alias("squared"),
        F.round(squared_l2(subvector("embedding", 1, 8), subvector("center", 1, 8)), 6).alias(
            "part_squared"
        ),
    )


@query(
    "sql_functions",
    """
    WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    c AS (SELECT label, v AS cv FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) = 1)
    SELECT id, round(list_distance(v, cv), 6) AS dist, CAST(least(greatest(5 * label, 50), 10000) AS INT) AS pool
    FROM e JOIN c USING (label)
    """,
)
def sql_functions(spark, sf_dir):
    """The SQL function surface: distance, literal round trip and pool size."""
    register_functions(spark)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("suite_embeddings")
    return spark.sql(
        """
        WITH c AS (SELECT label, min_by(embedding, vec_id) AS center FROM suite_embeddings GROUP BY label)
        SELECT vec_id AS id, round(l2_distance(vec_parse(vec_literal(embedding)), center), 6) AS dist,
               fetch_k(label) AS pool
        FROM suite_embeddings JOIN c USING (label)
        """
    )


@query(
    "vector_literal_roundtrip",
    """
    SELECT vec_id AS id, true AS same, 64 AS items FROM embeddings
    """,
)
def literal_roundtrip(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("text", vector_literal("embedding"))
    return rows.select(
        "id",
        parse_vector("text").eqNullSafe(F.col("embedding")).alias("same"),
        F.size(F.split("text", ",")).alias("items"),
    )


@query(
    "bucket_transform",
    """
    WITH RECURSIVE w AS (
      SELECT DISTINCT l_orderkey AS id, CAST(l_orderkey AS UHUGEINT) AS u FROM lineitem),
    k1 AS (SELECT id, u & 4294967295 AS lo, u >> 32 AS hi FROM w),
    k2 AS (SELECT id, (lo * 3432918353) & 4294967295 AS lo, (hi * 3432918353) & 4294967295 AS hi FROM k1),
    k3 AS (SELECT id, ((lo << 15) | (lo >> 17)) & 4294967295 AS lo, ((hi << 15) | (hi >> 17)) & 4294967295 AS hi FROM k2),
    k4 AS (SELECT id, (lo * 461845907) & 4294967295 AS h, (hi * 461845907) & 4294967295 AS hi FROM k3),
    k5 AS (SELECT id, ((((h << 13) | (h >> 19)) & 4294967295) * 5 + 3864292196) & 4294967295 AS h, hi FROM k4),
    k6 AS (SELECT id, xor(h, hi) AS h FROM k5),
    k7 AS (SELECT id, xor(((((h << 13) | (h >> 19)) & 4294967295) * 5 + 3864292196) & 4294967295, 8) AS h FROM k6),
    k8 AS (SELECT id, xor(h, h >> 16) AS h FROM k7),
    k9 AS (SELECT id, (h * 2246822507) & 4294967295 AS h FROM k8),
    k10 AS (SELECT id, xor(h, h >> 13) AS h FROM k9),
    k11 AS (SELECT id, (h * 3266489909) & 4294967295 AS h FROM k10),
    k12 AS (SELECT id, xor(h, h >> 16) AS h FROM k11)
    SELECT CAST((h & 2147483647) % 32 AS INT) AS id_bucket, count(*) AS n, CAST(sum(l.l_linenumber) AS BIGINT) AS lines
    FROM k12 JOIN lineitem l ON l.l_orderkey = k12.id GROUP BY 1
    """,
)
def bucket_transform(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return with_bucket(rows, "id", 32).groupBy("id_bucket").agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")
    )


@query(
    "fetch_pool",
    "SELECT p_partkey AS part, CAST(least(greatest(5 * p_size * p_size, 50), 10000) AS INT) AS pool FROM part",
)
def fetch_pool(spark, sf_dir):
    """Candidate pool size for a k taken from the table."""
    k = F.col("p_size") * F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), fetch_k_column(k).alias("pool")
    )
