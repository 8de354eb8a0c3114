"""Data-contract gates over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.operators import quality
from vectorloom.session import new_workdir
from vectorloom.sources.metadata import current_metadata
from vectorloom.suite.base import DIM, query, table, vectors
from vectorloom.suite.inputs import exported_vectors, metadata_documents


@query(
    "table_contract",
    "SELECT count(*) AS rows, min(vec_id) AS min_id, max(vec_id) AS max_id FROM embeddings",
)
def table_contract(spark, sf_dir):
    return quality.id_domain(vectors(spark, sf_dir))


@query(
    "table_contract_violations",
    """
    SELECT count(*) AS rows, min(l_orderkey) AS min_id, max(l_orderkey) AS max_id FROM lineitem
    """,
)
def table_contract_violations(spark, sf_dir):
    """Line items keyed by order do not meet the id contract of a vector table."""
    rows = table(spark, sf_dir, "lineitem")
    return quality.id_domain_violations(rows, rows.count(), 1, "l_orderkey")


@query(
    "duplicate_ids",
    "SELECT l_orderkey AS id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_ids(spark, sf_dir):
    return quality.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(
    "id_density",
    """
    SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_ids, max(l_orderkey) - min(l_orderkey) + 1 AS span
    FROM lineitem
    """,
)
def id_density(spark, sf_dir):
    return quality.id_gaps(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(
    "dim_violations",
    """
    SELECT vec_id AS id, CASE label WHEN 0 THEN 'null vector' WHEN 1 THEN 'wrong dimension' ELSE 'null element' END AS reason
    FROM embeddings WHERE label IN (0, 1, 2)
    """,
)
def dim_violations(spark, sf_dir):
    """Vectors damaged by label: missing, cut short, or holding a null element."""
    whole = F.col("embedding")
    damaged = (
        F.when(F.col("label") == 0, None)
        .when(F.col("label") == 1, F.slice(whole, 1, 32))
        .when(F.col("label") == 2, F.transform(whole, lambda x, i: F.when(i != 5, x)))
        .otherwise(whole)
    )
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), damaged.alias("embedding"))
    return quality.vector_violations(rows, DIM)


@query("dim_gate_passes", "SELECT vec_id AS id, '' AS reason FROM embeddings WHERE false")
def dim_gate_passes(spark, sf_dir):
    return quality.vector_violations(vectors(spark, sf_dir), DIM)


@query(
    "size_violations",
    """
    SELECT p_name AS name, CAST(p_size AS BIGINT) * 100 AS length, 4 * (1 + 24) * CAST(p_size AS BIGINT) + 0 AS expected_length,
           CAST(p_size AS BIGINT) * 100 % 100 AS trailing_bytes
    FROM part WHERE false
    UNION ALL
    SELECT concat('f', doc_id) AS name, n_chars AS length, (4 + 4 * 24) * (n_chars // 100) AS expected_length, n_chars % 100 AS trailing_bytes
    FROM documents WHERE n_chars <> 100 * (n_chars // 100)
    """,
)
def size_violations(spark, sf_dir):
    """Text lengths as file sizes: all that are not whole records of 24 values."""
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.col("n_chars").alias("length")
    )
    contract = files.select(
        "name", F.lit(24).alias("width"), F.expr("length div 100").alias("rows")
    )
    return quality.size_violations(files, contract)


@query(
    "checksum_manifest",
    """
    SELECT concat('f', doc_id) AS name FROM documents WHERE lang = 'fr'
    """,
)
def checksum_manifest(spark, sf_dir):
    """SHA-256 of every document against a manifest that is stale for one language."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name")
    files = docs.select(name, F.encode("text", "UTF-8").alias("content"))
    stale = F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    manifest = docs.select(name, F.sha2(F.encode(stale, "UTF-8"), 256).alias("sha256"))
    return quality.checksum_violations(files, manifest).select("name")


@query(
    "content_sha256",
    "SELECT doc_id, sha256(text) AS sha256 FROM documents",
)
def content_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")
    )


@query(
    "file_gate",
    "SELECT CAST(NULL AS BIGINT) AS length FROM embeddings WHERE false",
)
def file_gate(spark, sf_dir):
    """Exported record files pass the length gate and none is a pointer file."""
    path = exported_vectors(spark, sf_dir)
    quality.check_vector_files(spark, path, DIM, vectors(spark, sf_dir).count())
    return quality.pointer_files(spark, path).select("length")


@query(
    "metadata_audit",
    """
    SELECT concat('t', c_custkey) AS path, rule FROM customer, LATERAL (
      SELECT unnest([
        CASE WHEN c_nationkey = 3 THEN 'format version' END,
        CASE WHEN c_nationkey = 7 THEN 'snapshot' END,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'dimension property' END,
        CASE WHEN c_mktsegment = 'FURNITURE' THEN 'element type' END,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'partition spec' END]) AS rule) WHERE rule IS NOT NULL
    """,
)
def metadata_audit(spark, sf_dir):
    """Broken rules of every table's metadata document."""
    return quality.metadata_violations(current_metadata(metadata_documents(spark, sf_dir)))


@query(
    "head_state",
    """
    SELECT count(*) AS entries, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS BIGINT) AS local_metadata,
           CAST(sum(CASE WHEN o_orderkey = 0 AND o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS BIGINT) AS current
    FROM orders WHERE o_custkey = 0
    """,
)
def head_state(spark, sf_dir):
    """Head rows of one table: entries, usable metadata location, current snapshot."""
    scheme = F.when(F.col("o_orderstatus") == "P", "s3://").otherwise("file:///")
    heads = table(spark, sf_dir, "orders").select(
        F.lit("bench").alias("namespace"),
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table_name"),
        F.concat(scheme, F.lit("wh/"), F.col("o_orderkey").cast("string"), F.lit(".metadata.json")).alias(
            "metadata_location"
        ),
        F.col("o_orderkey").alias("snapshot_id"),
    )
    state = quality.head_state(heads, "bench", "t0", "file:///wh/0.metadata.json", 0)
    return state


@query(
    "catalog_filters",
    """
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (o_totalprice > 300000) AND o_custkey > 0
    ORDER BY o_orderkey
    """,
)
def catalog_filters(spark, sf_dir):
    """Equality, list and boolean predicates of the catalog checks; all reach the scan."""
    heavy = F.col("o_totalprice") > 300000
    return (
        table(spark, sf_dir, "orders")
        .where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .where(~heavy & (F.col("o_custkey") > 0))
        .select("o_orderkey", "o_orderpriority")
        .orderBy("o_orderkey")
    )


@query(
    "conditional_sums",
    """
    SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS high,
           CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open_lines
    FROM lineitem GROUP BY l_returnflag
    """,
)
def conditional_sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("high"),
        F.count_if(F.col("l_linestatus") == "O").alias("open_lines"),
    )


@query(
    "schema_contract",
    """
    SELECT unnest(['id must be long', 'embedding elements must be float']) AS problem, count(*) AS rows FROM embeddings
    """,
)
def schema_contract(spark, sf_dir):
    """Schema gate on a table whose types were changed; the problems, per row count."""
    wrong = vectors(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    problems = quality.schema_violations(wrong.schema, DIM)
    counted = wrong.agg(F.count("*").alias("rows"))
    return counted.select(F.explode(F.lit(problems)).alias("problem"), "rows")


@query(
    "pointer_files",
    """
    SELECT count(*) AS files FROM (SELECT DISTINCT event_type FROM events)
    """,
)
def pointer_files(spark, sf_dir):
    """Version-control stubs among written files: one stub per event type is found again."""
    path = new_workdir(spark, "stubs")
    stubs = table(spark, sf_dir, "events").select("event_type").distinct()
    body = F.concat(F.lit("version https://git-lfs.github.com/spec/v1 oid "), F.col("event_type"))
    stubs.select("event_type", body.alias("value")).repartition("event_type").write.partitionBy(
        "event_type"
    ).text(path)
    return quality.pointer_files(spark, path).agg(F.count("*").alias("files"))
