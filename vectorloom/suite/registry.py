"""Index registry: definitions, artifacts, orphans, removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.operators import registry
from vectorloom.suite.base import query, table
from vectorloom.suite.index import IVF, IVF_CTE, PQ, _E_CTE, ivf_index, pq_index


def index_kind():
    priority = F.col("o_orderpriority")
    kind = (
        F.when(priority == "1-URGENT", "ivf_flat")
        .when(priority == "2-HIGH", "ivf_pq")
        .when(priority == "3-MEDIUM", "btree")
        .otherwise("ivf_flat")
    )
    implementation = (
        F.when(priority == "1-URGENT", "ivf")
        .when(priority == "2-HIGH", "ivf_pq")
        .when(priority == "3-MEDIUM", "btree")
        .otherwise("ivf_pq")
    )
    return kind.alias("index_type"), implementation.alias("implementation")


KIND_SQL = """
CASE o_orderpriority WHEN '1-URGENT' THEN 'ivf_flat' WHEN '2-HIGH' THEN 'ivf_pq'
  WHEN '3-MEDIUM' THEN 'btree' ELSE 'ivf_flat' END AS index_type,
CASE o_orderpriority WHEN '1-URGENT' THEN 'ivf' WHEN '2-HIGH' THEN 'ivf_pq'
  WHEN '3-MEDIUM' THEN 'btree' ELSE 'ivf_pq' END AS implementation
"""


@query(
    "index_contracts",
    f"""
    WITH k AS (SELECT o_orderkey, {KIND_SQL} FROM orders)
    SELECT o_orderkey, index_type, implementation,
           CASE WHEN index_type = 'ivf_flat' AND implementation = 'ivf' THEN 'builtin.ivf_flat@2'
                WHEN index_type = 'ivf_pq' AND implementation = 'ivf_pq' THEN 'builtin.ivf_pq@1'
                WHEN index_type = 'btree' THEN 'BTree' END AS resolved
    FROM k
    """,
)
def index_contracts(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", *index_kind())
    return registry.resolve_contracts(wanted).select(
        "o_orderkey", "index_type", "implementation", "resolved"
    )


@query(
    "index_definition_audit",
    f"""
    WITH k AS (SELECT o_orderkey, o_custkey, o_orderstatus, {KIND_SQL} FROM orders),
    d AS (SELECT *, o_custkey % 12 AS nbits, o_custkey % 70 AS parts, o_custkey % 50 AS clusters FROM k)
    SELECT o_orderkey, rule FROM d, LATERAL (
      SELECT unnest([
        CASE WHEN o_orderstatus = 'O' THEN 'identifier' END,
        CASE WHEN clusters = 0 THEN 'num_clusters positive' END,
        CASE WHEN nbits NOT BETWEEN 1 AND 8 THEN 'nbits range' END,
        CASE WHEN parts = 0 THEN 'sub-quantizers positive' END,
        CASE WHEN parts > 0 AND 960 % parts <> 0 THEN 'sub-quantizers divide dimension' END,
        CASE WHEN index_type = 'ivf_flat' AND implementation = 'ivf_pq' THEN 'known contract' END]) AS rule)
    WHERE rule IS NOT NULL
    """,
)
def definition_audit(spark, sf_dir):
    """Orders as index definitions with out-of-range parameters."""
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    name = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Idx-"), key)).otherwise(
        F.concat(F.lit("idx_"), key)
    )
    definitions = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        name.alias("name"),
        *index_kind(),
        (customer % 50).alias("num_clusters"),
        F.lit(100_000).alias("sample_rate"),
        F.lit(8).alias("workers"),
        F.lit(960).alias("dim"),
        (customer % 70).alias("num_sub_quantizers"),
        (customer % 12).alias("nbits"),
    )
    return registry.definition_violations(definitions, ["o_orderkey"])


def artifact_name():
    """Artifact path of a line item; the return flag picks the file prefix."""
    prefix = (
        F.when(F.col("l_returnflag") == "A", "builtin.ivf_flat_v2_")
        .when(F.col("l_returnflag") == "N", "builtin.ivf_pq_v1_")
        .otherwise("segment_")
    )
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat(F.lit("/wh/t/indices/"), parts[0], F.lit("/"), prefix, F.concat_ws("-", *parts[1:]))


ARTIFACT_SQL = """
concat('/wh/t/indices/', l_orderkey, '/',
  CASE l_returnflag WHEN 'A' THEN 'builtin.ivf_flat_v2_' WHEN 'N' THEN 'builtin.ivf_pq_v1_' ELSE 'segment_' END,
  l_linenumber, '-', l_partkey, '-', l_suppkey)
"""


def order_registry(spark, sf_dir):
    """One registry row per line item: its order is the index, the item its only segment."""
    details = F.struct(
        F.lit(960).alias("dimension"),
        (F.col("l_linenumber") * 256).cast("int").alias("num_clusters"),
        F.lit(60).alias("num_sub_quantizers"),
        F.lit(8).alias("nbits"),
    )
    uri = F.concat(F.lit("file://"), artifact_name())
    files = F.array(F.struct(uri.alias("uri"), F.col("l_partkey").alias("size_bytes")))
    segments = F.array(F.struct(files.alias("artifact_files"), details.alias("algorithm_details")))
    state = (
        F.when(F.col("o_orderstatus") == "F", "active")
        .when(F.col("o_orderstatus") == "O", "building")
        .otherwise("failed")
    )
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return joined.select(
        F.lit("bench").alias("namespace"),
        F.when(F.col("l_linenumber") % 2 == 0, "t2").otherwise("t").alias("table_name"),
        F.lit("u-1").alias("table_uuid"),
        F.concat(F.lit("idx_"), F.col("o_orderkey").cast("string")).alias("name"),
        *index_kind(),
        state.alias("state"),
        F.array(F.struct(segments.alias("segments"))).alias("partitions"),
    )


def stored_files(spark, sf_dir):
    """Files on storage: zero-discount items are absent, zero-tax ones have another size."""
    items = table(spark, sf_dir, "lineitem")
    size = F.when(F.col("l_tax") == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    return items.where(F.col("l_discount") > 0).select(artifact_name().alias("path"), size.alias("length"))


REGISTRY_CTE = f"""
WITH r AS (
  SELECT concat('idx_', o_orderkey) AS name, o_orderstatus, {KIND_SQL}, {ARTIFACT_SQL} AS path,
         l_partkey AS size_bytes, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 't2' ELSE 't' END AS table_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT {ARTIFACT_SQL} AS path, CASE WHEN l_tax = 0 THEN l_partkey + 1 ELSE l_partkey END AS length
      FROM lineitem WHERE l_discount > 0)
"""


@query(
    "registry_verify",
    REGISTRY_CTE
    + """
    , v AS (SELECT r.*, CASE index_type WHEN 'ivf_flat' THEN 'builtin.ivf_flat_v2_' ELSE 'builtin.ivf_pq_v1_' END AS prefix
            FROM r WHERE o_orderstatus = 'F' AND ((index_type = 'ivf_flat' AND implementation = 'ivf') OR index_type = 'ivf_pq'))
    SELECT name, path, problem FROM (
      SELECT v.name, v.path, CASE WHEN NOT contains(v.path, '/' || v.prefix) THEN 'prefix'
               WHEN f.length IS NULL THEN 'missing' WHEN f.length <> v.size_bytes THEN 'size' END AS problem
      FROM v LEFT JOIN f ON f.path = v.path) WHERE problem IS NOT NULL
    """,
)
def registry_verify(spark, sf_dir):
    """Active vector indexes against the files on storage."""
    return registry.artifact_violations(order_registry(spark, sf_dir), stored_files(spark, sf_dir))


@query(
    "orphans",
    REGISTRY_CTE
    + """
    SELECT path, length FROM f WHERE path NOT IN (SELECT path FROM r WHERE o_orderstatus = 'F')
    """,
)
def orphan_files(spark, sf_dir):
    """Stored files that no active index names."""
    active = order_registry(spark, sf_dir).where(F.col("state") == "active")
    return registry.orphans(stored_files(spark, sf_dir), active)


@query(
    "distinct_details",
    """
    SELECT DISTINCT concat('{"dimension":960,"num_clusters":', l_linenumber * 256, ',"num_sub_quantizers":60,"nbits":8}') AS algorithm_details
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def distinct_details(spark, sf_dir):
    return registry.distinct_details(order_registry(spark, sf_dir))


@query(
    "drop_index",
    REGISTRY_CTE
    + "SELECT table_name, name, count(*) AS entries FROM r WHERE name <> 'idx_1' OR table_name <> 't' GROUP BY ALL",
)
def drop_index(spark, sf_dir):
    """Registry entries left after dropping one index; its namesake on another table stays."""
    left = registry.drop_index(order_registry(spark, sf_dir), "idx_1", "t", "bench")
    return left.groupBy("table_name", "name").agg(F.count("*").alias("entries"))


@query("index_entries", REGISTRY_CTE + "SELECT count(*) AS entries FROM r WHERE name = 'idx_1' AND table_name = 't'")
def index_entries(spark, sf_dir):
    return registry.entries_named(order_registry(spark, sf_dir), "idx_1", "t", "bench")


@query(
    "registry_heads",
    """
    SELECT path, problem FROM (
      SELECT concat('/wh/', doc_id) AS path,
        CASE WHEN lang = 'de' THEN 'missing' WHEN doc_id % 5 = 0 THEN 'size'
             WHEN doc_id % 7 = 0 THEN 'hash' WHEN doc_id % 11 = 0 THEN 'table uuid' END AS problem FROM documents)
    WHERE problem IS NOT NULL
    """,
)
def registry_heads(spark, sf_dir):
    """Recorded size, hash and owner of each registry file against the stored file."""
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.lit("/wh/"), key.cast("string")).alias("path")
    content = F.encode("text", "UTF-8")
    files = docs.where(F.col("lang") != "de").select(
        path,
        F.octet_length("text").cast("long").alias("length"),
        F.sha2(content, 256).alias("sha256"),
        F.lit("u-1").alias("file_uuid"),
    )
    heads = docs.select(
        path,
        (F.octet_length("text") + F.when(key % 5 == 0, 1).otherwise(0)).alias("file_size_bytes"),
        F.when(key % 7 == 0, F.lit("stale")).otherwise(F.sha2(content, 256)).alias("content_sha256"),
        F.when(key % 11 == 0, F.lit("u-2")).otherwise(F.lit("u-1")).alias("table_uuid"),
    )
    return registry.head_violations(heads, files)


def built_registry(spark, sf_dir):
    flat = registry.registry_entry(ivf_index(spark, sf_dir), "idx_flat", "bench", "vectors", "u-1")
    codes = registry.registry_entry(pq_index(spark, sf_dir), "idx_pq", "bench", "vectors", "u-1")
    return flat.unionByName(codes)


@query(
    "built_index_registry",
    """
    SELECT name, resolved, 64 AS dimension, 16 AS num_clusters, parts AS num_sub_quantizers, bits AS nbits, count(*) > 0 AS ok
    FROM embeddings, (VALUES ('idx_flat', 'builtin.ivf_flat@2', CAST(NULL AS INT), CAST(NULL AS INT)),
                             ('idx_pq', 'builtin.ivf_pq@1', 8, 4)) v(name, resolved, parts, bits)
    GROUP BY ALL
    """,
)
def built_index_registry(spark, sf_dir):
    """Registry rows of the two built indexes, with the details of their segments."""
    resolved = registry.resolve_contracts(built_registry(spark, sf_dir))
    details = registry.segments(resolved).select("name", "resolved", "algorithm_details.*")
    return details.groupBy(*details.columns).agg((F.count("*") > 0).alias("ok"))


@query(
    "built_index_orphans",
    "SELECT CAST(NULL AS BIGINT) AS length FROM embeddings WHERE false",
)
def built_index_orphans(spark, sf_dir):
    """Every file below the lists and codes of the built indexes is registered."""
    listing = None
    for index in (ivf_index(spark, sf_dir), pq_index(spark, sf_dir)):
        _, files = registry.stored_artifacts(index)
        listing = files if listing is None else listing.unionByName(files)
    return registry.orphans(listing, built_registry(spark, sf_dir)).select("length")


@query(
    "built_index_active",
    "SELECT CAST(NULL AS VARCHAR) AS problem, CAST(NULL AS BIGINT) AS n FROM embeddings WHERE false",
)
def built_index_active(spark, sf_dir):
    """Full check of the library's own index: nothing is wrong with it."""
    root, listing = registry.stored_artifacts(pq_index(spark, sf_dir))
    found = registry.active_index_violations(
        built_registry(spark, sf_dir), listing, "idx_pq", "vectors", "bench", "ivf_pq", "u-1", root,
        dimension=64, num_clusters=IVF.num_clusters, num_sub_quantizers=PQ.num_sub_quantizers, nbits=PQ.nbits,
    )
    return found.groupBy("problem").agg(F.count("*").alias("n"))


@query(
    "built_index_damaged",
    f"""
    WITH {_E_CTE}, {IVF_CTE}, l AS (SELECT DISTINCT list_id FROM assigned)
    SELECT CASE list_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'size' WHEN 2 THEN 'outside' ELSE 'prefix' END AS problem,
           count(*) AS lists
    FROM l WHERE list_id % 5 < 4 GROUP BY 1
    UNION ALL SELECT 'nbits', 0
    """,
)
def built_index_damaged(spark, sf_dir):
    """The same check after files were lost, cut, moved away or renamed, by list, and with misstated bits."""
    root, listing = registry.stored_artifacts(pq_index(spark, sf_dir))
    kind = F.regexp_extract("path", r"list_id=(\d+)", 1).cast("int") % 5

    def moved(path):
        renamed = F.replace(path, F.lit("builtin.ivf_pq_v1_codes/list_id"), F.lit("builtin.ivf_pq_v1_codes/../segments/list_id"))
        plain = F.replace(path, F.lit("builtin.ivf_pq_v1_"), F.lit("segment_"))
        return F.when(kind == 2, renamed).when(kind == 3, plain).otherwise(path)

    entries = registry.registry_entry(pq_index(spark, sf_dir), "idx_pq", "bench", "vectors", "u-1")
    uri = F.col("partitions")[0]["segments"][0]["artifact_files"][0]["uri"]
    size = F.col("partitions")[0]["segments"][0]["artifact_files"][0]["size_bytes"]
    named = entries.withColumns({"path": uri, "size": size})
    file = F.array(F.struct(moved(F.col("path")).alias("uri"), F.col("size").alias("size_bytes")))
    details = F.col("partitions")[0]["segments"][0]["algorithm_details"]
    segment = F.struct(file.alias("artifact_files"), details.alias("algorithm_details"))
    entries = named.withColumn("partitions", F.array(F.struct(F.array(segment).alias("segments")))).drop("path", "size")
    stored = listing.where(kind != 0).select(
        moved(F.col("path")).alias("path"), (F.col("length") - F.when(kind == 1, 1).otherwise(0)).alias("length")
    )
    found = registry.active_index_violations(
        entries, stored, "idx_pq", "vectors", "bench", "ivf_pq", "u-1",
        dimension=64, num_clusters=IVF.num_clusters, num_sub_quantizers=PQ.num_sub_quantizers, nbits=PQ.nbits + 4,
    )
    lists = F.countDistinct(F.nullif(F.regexp_extract("path", r"list_id=(\d+)", 1), F.lit("")))
    return found.groupBy("problem").agg(lists.alias("lists"))
