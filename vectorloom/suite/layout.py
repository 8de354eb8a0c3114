"""Table layouts, appends, audits, lookups, published versions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vectorloom.functions.bucket import with_bucket
from vectorloom.operators import layout
from vectorloom.operators.ids import dense_ids
from vectorloom.operators.quality import bucket_violations, fingerprint, mixed_files
from vectorloom.session import new_workdir
from vectorloom.suite.base import DIM, query, table, vectors
from vectorloom.suite.index import BUCKET_CTE

LAYOUT_SQL = f"""
WITH {BUCKET_CTE}
SELECT b.id, b.id_bucket, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
FROM bucket b JOIN embeddings ON vec_id = b.id
"""

PLAIN_SQL = """
SELECT vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings
"""


def vector_total():
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.round(total, 6).alias("total")


def bucketed_table(spark, sf_dir, **options) -> str:
    path = layout.table_path(new_workdir(spark, "warehouse"), "bench", "vectors")
    layout.create_table(vectors(spark, sf_dir), path, buckets=32, dim=DIM, **options)
    return path


@query("bucket_layout", LAYOUT_SQL)
def bucket_layout(spark, sf_dir):
    """Bucketed table read back with its partition values."""
    rows = spark.read.parquet(bucketed_table(spark, sf_dir))
    return rows.select("id", "id_bucket", vector_total())


@query("bucket_layout_split_writers", LAYOUT_SQL)
def bucket_layout_split(spark, sf_dir):
    """Several writers per bucket and a compressed codec change files, not rows."""
    path = bucketed_table(spark, sf_dir, writers_per_bucket=3, compression="zstd")
    return spark.read.parquet(path).select("id", "id_bucket", vector_total())


@query(
    "bucket_files_pure",
    "SELECT CAST(NULL AS INT) AS lowest, CAST(NULL AS INT) AS highest FROM embeddings WHERE false",
)
def bucket_files_pure(spark, sf_dir):
    """Every data file of the bucketed table holds one bucket."""
    rows = spark.read.parquet(bucketed_table(spark, sf_dir))
    return mixed_files(rows).select("lowest", "highest")


@query(
    "bucket_values_checked",
    f"WITH {BUCKET_CTE} SELECT id, CAST(id % 32 AS INT) AS id_bucket, id_bucket AS expected FROM bucket WHERE id_bucket <> id % 32",
)
def bucket_values_checked(spark, sf_dir):
    """Gate on a table whose partition value was computed with another function."""
    wrong = vectors(spark, sf_dir).select("id", (F.col("id") % 32).cast("int").alias("id_bucket"))
    return bucket_violations(wrong, 32)


@query(
    "mixed_bucket_files",
    f"WITH {BUCKET_CTE} SELECT min(id_bucket) AS lowest, max(id_bucket) AS highest FROM bucket",
)
def mixed_bucket_files(spark, sf_dir):
    """The same gate on a file that rows of all buckets were written to."""
    path = new_workdir(spark, "mixed")
    with_bucket(vectors(spark, sf_dir), "id", 32).coalesce(1).write.parquet(path)
    return mixed_files(spark.read.parquet(path)).select("lowest", "highest")


FILE_ROWS = 7


@query(
    "bucket_file_sizes",
    f"""
    WITH {BUCKET_CTE}
    SELECT id_bucket, count(*) AS rows, (count(*) + {FILE_ROWS - 1}) // {FILE_ROWS} AS files FROM bucket GROUP BY id_bucket
    """,
)
def bucket_file_sizes(spark, sf_dir):
    """A small file-size target: each bucket is cut into as many files as it takes."""
    target = FILE_ROWS * (4 * DIM + 8)
    rows = spark.read.parquet(bucketed_table(spark, sf_dir, target_file_bytes=target))
    return rows.groupBy("id_bucket").agg(
        F.count("*").alias("rows"), F.countDistinct("_metadata.file_path").alias("files")
    )


@query("existing_table_refused", "SELECT count(*) AS rows, true AS refused FROM embeddings")
def existing_table_refused(spark, sf_dir):
    """A second load of a table fails and leaves the first one as it was."""
    path = bucketed_table(spark, sf_dir)
    try:
        layout.create_table(vectors(spark, sf_dir), path, buckets=32, dim=DIM)
        refused = False
    except AnalysisException as error:
        refused = "PATH_ALREADY_EXISTS" in str(error)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.lit(refused).alias("refused"))


@query(
    "dense_ids",
    """
    SELECT o_orderpriority, o_orderstatus, customers,
           row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, customers) + 99 AS id
    FROM (SELECT o_orderpriority, o_orderstatus, o_custkey % 7 AS customers FROM orders)
    """,
)
def numbered_orders(spark, sf_dir):
    """Ids from 100 for rows without any, most of which are alike."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 7).alias("customers")
    )
    return dense_ids(rows, ["o_orderpriority", "o_orderstatus", "customers"], first=100)


@query("unpartitioned_layout", PLAIN_SQL)
def unpartitioned_layout(spark, sf_dir):
    path = new_workdir(spark, "plain")
    layout.create_table(vectors(spark, sf_dir), path, buckets=0, data_files=4, compression="snappy")
    return spark.read.parquet(path).select("id", vector_total())


@query("batched_append", LAYOUT_SQL)
def batched_append(spark, sf_dir):
    """Id ranges appended one after another give the same table as one load."""
    rows = vectors(spark, sf_dir)
    total = rows.count()
    path = new_workdir(spark, "batched")
    layout.append_in_batches(rows, path, total, 0, -(-total // 3), 32)
    return spark.read.parquet(path).select("id", "id_bucket", vector_total())


@query(
    "batch_ranges",
    """
    WITH n AS (SELECT count(*) AS n FROM lineitem)
    SELECT i AS batch_no, i * 997 AS first, least(997, n - i * 997) AS rows
    FROM n, range((n + 996) // 997) t(i)
    """,
)
def batch_ranges(spark, sf_dir):
    return layout.batch_ranges(spark, table(spark, sf_dir, "lineitem").count(), 997)


@query(
    "load_audit",
    """
    SELECT 'spark' AS provider, count(*) AS rows, 32 AS buckets, true AS has_bytes FROM embeddings
    """,
)
def load_audit(spark, sf_dir):
    audit = layout.load_audit(spark, bucketed_table(spark, sf_dir), "spark", 32)
    return audit.select(
        "provider", "rows", "buckets", ((F.col("files") >= 1) & (F.col("bytes") > 0)).alias("has_bytes")
    )


@query(
    "published_head",
    "SELECT count(*) AS rows, min(vec_id) AS min_id, max(vec_id) AS max_id FROM embeddings",
)
def published_head(spark, sf_dir):
    """Two versions of a table; readers follow the pointer to the later one."""
    root = new_workdir(spark, "versions")
    rows = vectors(spark, sf_dir)
    layout.write_unpartitioned(rows.where(F.col("embedding")[0] > 0), f"{root}/v1", 2)
    layout.publish(spark, f"{root}/head", "bench", "vectors", f"{root}/v1", 1)
    layout.write_unpartitioned(rows, f"{root}/v2", 2)
    layout.publish(spark, f"{root}/head", "bench", "vectors", f"{root}/v2", 2)
    head = layout.read_head(spark, f"{root}/head", "bench", "vectors")
    return head.agg(
        F.count("*").alias("rows"), F.min("id").alias("min_id"), F.max("id").alias("max_id")
    )


def clustered_orders(spark, sf_dir):
    path = new_workdir(spark, "orders")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    layout.write_id_clustered(orders, path, 8, id_col="o_orderkey")
    return spark.read.parquet(path)


@query(
    "id_point_lookup",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderkey = (SELECT count(*) // 2 FROM orders)
    """,
)
def id_point_lookup(spark, sf_dir):
    rows = clustered_orders(spark, sf_dir)
    return rows.where(F.col("o_orderkey") == F.lit(rows.count() // 2))


@query(
    "id_range_lookup",
    """
    WITH n AS (SELECT count(*) AS n FROM orders)
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders, n
    WHERE o_orderkey BETWEEN n // 3 AND n // 2
    """,
)
def id_range_lookup(spark, sf_dir):
    rows = clustered_orders(spark, sf_dir)
    count = rows.count()
    return rows.where(F.col("o_orderkey").between(count // 3, count // 2))


@query("layout_fingerprint")
def layout_fingerprint(spark, sf_dir):
    """Content fingerprint per bucket (the 64-bit hash has no SQL counterpart)."""
    rows = with_bucket(vectors(spark, sf_dir), "id", 32)
    return fingerprint(rows, ["id_bucket"])
