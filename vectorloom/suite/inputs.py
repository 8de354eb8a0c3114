"""Sources: record files, settings, run logs, metadata documents, listings, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.functions import text
from vectorloom.operators.exact import knn_batch
from vectorloom.operators.evaluate import truth_lists, unknown_ids, vectors_of
from vectorloom.session import new_workdir
from vectorloom.sources import records
from vectorloom.sources.metadata import (
    contract_table,
    current_metadata,
    latest_metadata,
    provider_table,
    unsupported_requests,
)
from vectorloom.sources.text import (
    queries_without_time,
    read_lines,
    returned_ids,
    settings,
    settings_maps,
    statement_times,
    write_lines,
)
from vectorloom.suite.base import DIM, EXACT_CTE, K, all_queries, query, table, vectors

# --- fvecs / ivecs ------------------------------------------------------------------------


def exported_vectors(spark, sf_dir) -> str:
    """The embeddings as fvecs files in id order (ids are dense from 0)."""
    path = new_workdir(spark, "fvecs")
    rows = vectors(spark, sf_dir)
    files = max(4, rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(files, "id").sortWithinPartitions("id")
    records.write_records(ordered, path, DIM)
    return path


VECTOR_SUMS = """
SELECT vec_id + 1 AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total,
       embedding[1] AS first_value, embedding[64] AS last_value FROM embeddings
"""


def vector_sums(rows):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select(
        "id",
        F.round(total, 6).alias("total"),
        F.col("embedding")[0].alias("first_value"),
        F.col("embedding")[DIM - 1].alias("last_value"),
    )


@query("fvecs_scan", VECTOR_SUMS)
def fvecs_scan(spark, sf_dir):
    path = exported_vectors(spark, sf_dir)
    return vector_sums(records.read_fvecs(spark, path, DIM, id_base=1))


@query("fvecs_small_splits", VECTOR_SUMS)
def fvecs_small_splits(spark, sf_dir):
    """Many byte ranges per file give the same ids."""
    path = exported_vectors(spark, sf_dir)
    return vector_sums(
        records.read_fvecs(spark, path, DIM, id_base=1, split_bytes=37 * records.record_bytes(DIM))
    )


@query(
    "fvecs_at_ordinals",
    """
    WITH n AS (SELECT count(*) AS n FROM embeddings),
    s AS (SELECT i AS position, (i * (n - 1)) // 19 AS ordinal FROM range(20) t(i), n)
    SELECT s.position, s.ordinal, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
    FROM s JOIN embeddings ON vec_id = s.ordinal
    """,
)
def fvecs_at_ordinals(spark, sf_dir):
    path = exported_vectors(spark, sf_dir)
    total = vectors(spark, sf_dir).count()
    wanted = [i * (total - 1) // 19 for i in range(20)]
    found = records.read_fvecs_at(spark, path, wanted, DIM)
    value = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("position", "ordinal", F.round(value, 6).alias("total"))


@query(
    "fvecs_ordinals_join",
    """
    WITH n AS (SELECT count(*) AS n FROM embeddings)
    SELECT event_id, user_id % n AS ordinal, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
    FROM events, n JOIN embeddings ON vec_id = user_id % n
    """,
)
def fvecs_ordinals_join(spark, sf_dir):
    """Every event asks for the vector at an ordinal of its own; many ask for the same."""
    path = exported_vectors(spark, sf_dir)
    count = table(spark, sf_dir, "embeddings").count()
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % count).alias("ordinal"))
    found = records.read_fvecs_ordinals(path, asked, DIM, split_bytes=50 * records.record_bytes(DIM))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("event_id", "ordinal", F.round(total, 6).alias("total"))


@query(
    "ivecs_truth",
    f"""
    WITH {EXACT_CTE} SELECT query_index, rk, id + 1 AS id FROM exact WHERE rk <= 5
    """,
)
def ivecs_truth(spark, sf_dir):
    """Ground truth written as ivecs, first five neighbours read back with id base 1."""
    found = knn_batch(vectors(spark, sf_dir), all_queries(spark, sf_dir), K)
    lists = truth_lists(found).select(
        "query_index", F.transform("neighbors", lambda x: x.cast("int")).alias("neighbors")
    )
    path = new_workdir(spark, "ivecs")
    records.write_records(
        lists.repartitionByRange(4, "query_index").sortWithinPartitions("query_index"), path, K, "ivecs"
    )
    read = records.read_ivecs(spark, path, K, k=5, id_base=1)
    return read.select("query_index", F.posexplode("neighbors").alias("pos", "id")).select(
        "query_index", (F.col("pos") + 1).cast("long").alias("rk"), "id"
    )


@query(
    "record_count",
    "SELECT count(*) AS records, count(*) * 260 AS bytes FROM embeddings",
)
def record_count(spark, sf_dir):
    counted = records.record_count(spark, exported_vectors(spark, sf_dir), DIM)
    return counted.agg(F.sum("records").alias("records"), F.sum("length").alias("bytes"))


@query(
    "header_check",
    "SELECT CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS INT) AS header FROM embeddings WHERE false",
)
def header_check(spark, sf_dir):
    """Every record header equals the dimension."""
    path = exported_vectors(spark, sf_dir)
    return records.header_violations(spark, path, DIM).select("ordinal", "header")


@query("header_check_damaged", "SELECT CAST(129 AS INT) AS header, count(*) AS n FROM embeddings")
def header_check_damaged(spark, sf_dir):
    """The same check of records twice as long as expected: each first half bears a wrong header.

    What stands where the second halves should have theirs are vector elements, not counted here.
    """
    path = new_workdir(spark, "fvecs")
    twice = F.concat("embedding", "embedding", F.array(F.lit(0.0).cast("float")))
    records.write_records(vectors(spark, sf_dir).select("id", twice.alias("embedding")), path, 2 * DIM + 1)
    found = records.header_violations(spark, path, DIM)
    return found.where(F.col("header") == 2 * DIM + 1).groupBy("header").agg(F.count("*").alias("n"))


# --- lookups ------------------------------------------------------------------------------


@query(
    "vector_lookup",
    """
    SELECT o_orderkey AS query_index, vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
    FROM orders JOIN embeddings ON vec_id = o_custkey
    """,
)
def vector_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_index"), F.col("o_custkey").alias("id")
    )
    found = vectors_of(ids, vectors(spark, sf_dir))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("query_index", "id", F.round(total, 6).alias("total"))


@query(
    "unknown_ids",
    """
    SELECT o_orderkey AS query_index, o_custkey AS id FROM orders
    WHERE NOT (o_custkey BETWEEN 0 AND (SELECT count(*) - 1 FROM embeddings))
    """,
)
def unknown(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_index"), F.col("o_custkey").alias("id")
    )
    return unknown_ids(ids, 0, vectors(spark, sf_dir).count())


# --- settings -----------------------------------------------------------------------------


def setting_lines(spark, sf_dir):
    """Each event is one line of its user's settings file."""
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    line = (
        F.when(kind == "view", F.concat(F.lit("export TOP_K="), number))
        .when(kind == "click", F.concat(F.lit("  export LISTS_READ = '"), number, F.lit("' ")))
        .when(kind == "signup", F.concat(F.lit("RUN_NAME=run="), number))
        .when(kind == "purchase", F.concat(F.lit("# TOP_K="), number))
        .otherwise(F.concat(F.lit("noise "), number))
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file"),
        F.expr("event_id div 1000").alias("chunk"),
        F.col("event_id").alias("seq"),
        line.alias("line"),
    )


SETTINGS_CTE = """
WITH l AS (
  SELECT concat('user-', user_id) AS file, event_id,
    CASE event_type WHEN 'view' THEN concat('export TOP_K=', event_id)
      WHEN 'click' THEN concat('  export LISTS_READ = ''', event_id, ''' ')
      WHEN 'signup' THEN concat('RUN_NAME=run=', event_id)
      WHEN 'purchase' THEN concat('# TOP_K=', event_id)
      ELSE concat('noise ', event_id) END AS raw FROM events),
t AS (SELECT file, event_id, regexp_replace(trim(raw), '^export ', '') AS body FROM l
      WHERE trim(raw) NOT LIKE '#%' AND contains(raw, '=')),
p AS (SELECT file, event_id, trim(split_part(body, '=', 1)) AS key,
             trim(trim(substr(body, strpos(body, '=') + 1)), '''"') AS value FROM t),
s AS (SELECT file, key, arg_max(value, event_id) AS value FROM p GROUP BY file, key)
"""


@query("settings_last_wins", SETTINGS_CTE + "SELECT file, key, value FROM s")
def settings_last_wins(spark, sf_dir):
    return settings(setting_lines(spark, sf_dir))


@query(
    "settings_defaults",
    SETTINGS_CTE
    + """
    SELECT f.file, coalesce(k.value, '10') AS k, coalesce(d.value, '1') AS dop
    FROM (SELECT DISTINCT file FROM s) f
    LEFT JOIN s k ON k.file = f.file AND k.key = 'TOP_K'
    LEFT JOIN s d ON d.file = f.file AND d.key = 'PARALLEL'
    """,
)
def settings_defaults(spark, sf_dir):
    maps = settings_maps(setting_lines(spark, sf_dir))
    return maps.select(
        "file",
        text.setting_or("settings", "TOP_K", "10").alias("k"),
        text.setting_or("settings", "PARALLEL", "1").alias("dop"),
    )


# --- run logs -----------------------------------------------------------------------------


def log_lines(spark, sf_dir):
    """Events as benchmark output: noise, begin marker, ids, time, end marker, stray number."""
    number = F.col("event_id").cast("string")
    timed = F.concat(F.lit("Time: "), F.col("value").cast("string"), F.lit(" ms"))
    parts = F.array(
        F.lit("Timing is on."),
        F.concat(F.lit("__MVP_QUERY_BEGIN_"), number, F.lit("__")),
        F.concat(F.lit(" "), (F.col("event_id") * 2).cast("string")),
        (F.col("event_id") * 2 + 1).cast("string"),
        F.when(F.col("event_type") == "error", "ERROR: timeout").otherwise(timed),
        F.concat(F.lit("__MVP_QUERY_END_"), number, F.lit("__")),
        F.lit("4711"),
    )
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("file"),
        "event_id",
        F.posexplode(parts).alias("part", "line"),
    )
    seq = F.col("event_id") * 7 + F.col("part")
    return rows.select("file", F.floor(seq / 9973).alias("chunk"), seq.alias("seq"), "line")


LOG_CTE = r"""
WITH p AS (
  SELECT concat('run-', user_id) AS file, event_id, event_type, [
    'Timing is on.', concat('__MVP_QUERY_BEGIN_', event_id, '__'), concat(' ', event_id * 2),
    concat(event_id * 2 + 1),
    CASE WHEN event_type = 'error' THEN 'ERROR: timeout' ELSE concat('Time: ', value, ' ms') END,
    concat('__MVP_QUERY_END_', event_id, '__'), '4711'] AS parts FROM events),
l AS (SELECT file, event_id * 7 + pos - 1 AS seq, trim(line) AS line FROM (
  SELECT file, event_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM p)),
k AS (SELECT *, CASE WHEN regexp_full_match(line, '__MVP_QUERY_BEGIN_\d+__')
                     THEN CAST(regexp_extract(line, '(\d+)', 1) AS BIGINT)
                     WHEN regexp_full_match(line, '__MVP_QUERY_END_\d+__') THEN -1 END AS marker FROM l),
o AS (SELECT *, last_value(marker IGNORE NULLS) OVER (
        PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING) AS query_no FROM k),
q AS MATERIALIZED (SELECT * FROM o WHERE marker IS NULL AND query_no >= 0)
"""


@query(
    "log_returned_ids",
    LOG_CTE
    + r"""
    SELECT file, query_no, row_number() OVER (PARTITION BY file, query_no ORDER BY seq) AS rk,
           CAST(line AS BIGINT) AS id FROM q WHERE regexp_full_match(line, '-?\d+')
    """,
)
def log_ids(spark, sf_dir):
    return returned_ids(log_lines(spark, sf_dir)).withColumn("rk", F.col("rk").cast("long"))


@query(
    "log_statement_times",
    LOG_CTE
    + r"""
    SELECT file, query_no, CAST(regexp_extract(line, 'Time:\s+([0-9.]+)\s+ms', 1) AS DOUBLE) AS elapsed_ms
    FROM q WHERE line LIKE 'Time:%'
    """,
)
def log_times(spark, sf_dir):
    return statement_times(log_lines(spark, sf_dir))


@query(
    "log_files_roundtrip",
    LOG_CTE
    + r"""
    SELECT query_no, CAST(regexp_extract(line, 'Time:\s+([0-9.]+)\s+ms', 1) AS DOUBLE) AS elapsed_ms
    FROM q WHERE line LIKE 'Time:%'
    """,
)
def log_files(spark, sf_dir):
    """The same logs as text files: line order comes from split offsets."""
    path = new_workdir(spark, "logs")
    lines = log_lines(spark, sf_dir).withColumnRenamed("file", "run").withColumn("event", F.expr("seq div 7"))
    write_lines(lines, path, ["run", "event"], ["seq"])
    return statement_times(read_lines(spark, path)).select("query_no", "elapsed_ms")


@query(
    "log_missing_times",
    """
    SELECT event_id AS query_no FROM events WHERE event_type = 'error'
    """,
)
def log_missing(spark, sf_dir):
    """Queries that were begun but reported no time."""
    return queries_without_time(log_lines(spark, sf_dir)).select("query_no")


# --- metadata documents -------------------------------------------------------------------


def metadata_documents(spark, sf_dir):
    """One table-metadata document per customer, with faults tied to its columns.

    Columns besides ``document``: the contract (``dim``, ``buckets``) and ``path``.
    """
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    dim = F.when(F.col("c_custkey") % 2 == 0, 128).otherwise(960)
    stated = F.when(segment == "BUILDING", dim.cast("string")).otherwise(
        F.concat(F.lit('"'), dim.cast("string"), F.lit('"'))
    )
    vector = F.when(
        segment == "FURNITURE",
        F.lit('{"type":"list","element-id":3,"element":"double","element-required":true}'),
    ).otherwise(F.lit('{"type":"list","element-id":3,"element":"float","element-required":true}'))
    spec = F.when(
        segment == "MACHINERY",
        F.lit('{"source-id":1,"field-id":1000,"name":"id_bucket","transform":"bucket[16]"}'),
    ).otherwise(F.lit('{"source-id":1,"field-id":1000,"name":"id_bucket","transform":"bucket[32]"}'))
    snapshot = F.when(nation == 7, F.lit("null")).otherwise(F.col("c_custkey").cast("string"))
    version = F.when(nation == 3, F.lit("1")).otherwise(F.lit("2"))
    document = F.concat(
        F.lit('{"format-version":'), version,
        F.lit(',"table-uuid":"'), F.col("c_name"),
        F.lit('","location":"file:///wh/'), F.col("c_custkey").cast("string"),
        F.lit('","current-snapshot-id":'), snapshot,
        F.lit(',"current-schema-id":1,"schemas":[{"schema-id":0,"fields":[]},{"schema-id":1,"fields":['
              '{"id":1,"name":"id","required":true,"type":"long"},'
              '{"id":2,"name":"embedding","required":true,"type":'), vector,
        F.lit('}]}],"default-spec-id":0,"partition-specs":[{"spec-id":0,"fields":['), spec,
        F.lit(']}],"properties":{"vector_dim.embedding":'), stated, F.lit("}}"),
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("path"),
        dim.cast("long").alias("dim"),
        F.lit(32).cast("long").alias("buckets"),
        document.alias("document"),
    )


@query(
    "metadata_current",
    """
    SELECT concat('t', c_custkey) AS path, CASE WHEN c_nationkey = 3 THEN 1 ELSE 2 END AS format_version,
           CASE WHEN c_nationkey = 7 THEN NULL ELSE c_custkey END AS snapshot_id,
           CASE WHEN c_custkey % 2 = 0 THEN '128' ELSE '960' END AS dim_property,
           c_mktsegment <> 'BUILDING' AS dim_is_text,
           CASE WHEN c_mktsegment = 'MACHINERY' THEN 'bucket[16]' ELSE 'bucket[32]' END AS transform, 2 AS fields
    FROM customer
    """,
)
def metadata_current(spark, sf_dir):
    parsed = current_metadata(metadata_documents(spark, sf_dir))
    return parsed.select(
        "path",
        "format_version",
        "snapshot_id",
        "dim_property",
        "dim_is_text",
        F.col("spec_fields")[0]["transform"].alias("transform"),
        F.size("fields").alias("fields"),
    )


@query(
    "latest_metadata",
    """
    WITH f AS (
      SELECT l_orderkey AS tab, l_linenumber * 3 AS v,
             concat('file:///wh/t', l_orderkey, '/metadata/v', l_linenumber * 3, '.metadata.json') AS path,
             CASE WHEN l_orderkey % 2 = 0 THEN 9 END AS hint FROM lineitem)
    SELECT tab, arg_max(path, CASE WHEN v = hint THEN 1000000 ELSE v END) AS path,
           arg_max(CAST(v AS BIGINT), CASE WHEN v = hint THEN 1000000 ELSE v END) AS version FROM f GROUP BY tab
    """,
)
def latest(spark, sf_dir):
    """Hinted version if it exists, otherwise the highest number (not the highest text)."""
    number = F.col("l_linenumber") * 3
    listing = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tab"),
        F.concat(
            F.lit("file:///wh/t"), F.col("l_orderkey").cast("string"), F.lit("/metadata/v"),
            number.cast("string"), F.lit(".metadata.json"),
        ).alias("path"),
        F.when(F.col("l_orderkey") % 2 == 0, F.lit(9).cast("long")).alias("hint"),
    )
    return latest_metadata(listing, ["tab"])


@query(
    "json_contract",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_contract(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k long")["k"].alias("k")
    )


@query(
    "dataset_dispatch",
    """
    WITH r AS (
      SELECT s_suppkey AS request, CASE WHEN s_nationkey % 2 = 0 THEN 'sift1m' ELSE 'gist1m' END AS dataset,
             CASE s_nationkey % 3 WHEN 0 THEN 'spark' WHEN 1 THEN 'pyiceberg' ELSE 'rust' END AS provider
      FROM supplier)
    SELECT request, dataset, provider FROM r WHERE dataset = 'gist1m' AND provider <> 'pyiceberg'
    """,
)
def dataset_dispatch(spark, sf_dir):
    """Load requests that no producer serves."""
    nation = F.col("s_nationkey")
    requests = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request"),
        F.when(nation % 2 == 0, "sift1m").otherwise("gist1m").alias("dataset"),
        F.when(nation % 3 == 0, "spark").when(nation % 3 == 1, "pyiceberg").otherwise("rust").alias("provider"),
    )
    return unsupported_requests(requests, provider_table(spark)).select("request", "dataset", "provider")


@query(
    "dataset_contract_join",
    """
    WITH c(dataset, dim, rows) AS (VALUES ('sift1m', 128, 1000000), ('gist1m', 960, 1000000))
    SELECT s_suppkey AS request, c.dataset, CAST(c.rows AS BIGINT) * (4 + 4 * c.dim) AS bytes
    FROM supplier JOIN c ON c.dataset = CASE WHEN s_nationkey % 2 = 0 THEN 'sift1m' ELSE 'gist1m' END
    """,
)
def dataset_contracts(spark, sf_dir):
    """Expected base-file size of every request from the contract table."""
    dataset = F.when(F.col("s_nationkey") % 2 == 0, "sift1m").otherwise("gist1m")
    requests = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request"), dataset.alias("dataset")
    )
    size = F.col("rows") * (F.col("dim") * 4 + 4)
    return requests.join(F.broadcast(contract_table(spark)), "dataset").select(
        "request", "dataset", size.alias("bytes")
    )


# --- text predicates ----------------------------------------------------------------------


@query(
    "identifiers",
    """
    SELECT doc_id, source, regexp_full_match(source, '[a-z_][a-z0-9_]*') AS ok FROM documents
    """,
)
def identifiers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", text.is_identifier("source").alias("ok")
    )


@query(
    "location_paths",
    """
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '/wh/' || page_id WHEN page_id % 4 = 1 THEN '/wh/a b+' || page_id
                         WHEN page_id % 4 = 2 THEN '/wh/' || page_id END AS path FROM pages
    """,
)
def location_paths(spark, sf_dir):
    """Bare paths, escaped file URIs, localhost URIs and the pages' own web addresses."""
    page = F.col("page_id").cast("string")
    location = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/wh/"), page))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("file:///wh/a%20b+"), page))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("file://localhost/wh/"), page))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", text.local_path(location).alias("path"))


@query(
    "missing_markers",
    """
    SELECT doc_id, array_to_string(list_filter(['The', 'LICENSE', 'copyright'], lambda m: NOT contains(lower(text), lower(m))), ',') AS missing
    FROM documents
    """,
)
def missing_markers(spark, sf_dir):
    missing = text.missing_markers("text", ["The", "LICENSE", "copyright"])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(missing, ",").alias("missing"))


@query(
    "int_lists",
    """
    SELECT p_partkey AS part, CASE WHEN p_size > 10 THEN concat(p_size, ',', p_size + 1) END AS items FROM part
    """,
)
def int_lists(spark, sf_dir):
    """Comma lists of positive integers; a zero, a word or an empty item voids the list."""
    size = F.col("p_size").cast("string")
    raw = (
        F.when(F.col("p_size") > 10, F.concat(size, F.lit(" , "), (F.col("p_size") + 1).cast("string")))
        .when(F.col("p_size") > 5, F.concat(size, F.lit(",0")))
        .when(F.col("p_size") > 2, F.concat(size, F.lit(",x")))
        .otherwise(F.concat(size, F.lit(",,1")))
    )
    parsed = text.positive_ints(raw)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"),
        F.array_join(F.transform(parsed, lambda x: x.cast("string")), ",").alias("items"),
    )


@query(
    "scenario_labels",
    """
    SELECT event_id, concat(event_type, '-k', user_id, '-dop', event_id % 8, '-r', event_id % 3) AS label FROM events
    """,
)
def scenario_labels(spark, sf_dir):
    label = text.scenario_label("event_type", "user_id", F.col("event_id") % 8, F.col("event_id") % 3)
    return table(spark, sf_dir, "events").select("event_id", label.alias("label"))
