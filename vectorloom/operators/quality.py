"""Data-contract gates. Each returns a table of violations; an empty table means pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructType

from vectorloom.functions.bucket import with_bucket
from vectorloom.sources.metadata import BUCKET_FIELD, FORMAT_VERSION, field_named
from vectorloom.sources.records import file_listing, record_bytes


class GateError(ValueError):
    """A gate found violations."""


def require_empty(violations: DataFrame, gate: str, show: int = 5) -> None:
    found = violations.take(show)
    if found:
        raise GateError(f"{gate}: " + "; ".join(str(row.asDict()) for row in found))


# --- files --------------------------------------------------------------------------------


def size_violations(listing: DataFrame, contract: DataFrame) -> DataFrame:
    """Files whose length is not ``rows`` whole records of ``width`` (both in ``contract``).

    Also tells partial records (``trailing_bytes``) from a wrong record count.
    """
    record = F.lit(4).cast("long") + F.lit(4) * F.col("width")
    joined = listing.join(contract, "name")
    return joined.select(
        "name",
        "length",
        (record * F.col("rows")).alias("expected_length"),
        (F.col("length") % record).alias("trailing_bytes"),
    ).where(F.col("length") != F.col("expected_length"))


def named_listing(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return file_listing(spark, path).withColumn("name", name)


def pointer_files(spark: SparkSession, path: str, size_limit: int = 1024) -> DataFrame:
    """Files that are version-control pointers instead of data; only tiny files are opened."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .where(F.col("length") <= size_limit)
    )
    head = F.decode(F.substring("content", 1, 80), "ISO-8859-1")
    return files.where(F.contains(head, F.lit("git-lfs"))).select("path", "length")


def checksum_violations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files ``(name, content)`` that miss or contradict ``manifest (name, sha256)``."""
    actual = files.select("name", F.sha2("content", 256).alias("actual"))
    return manifest.join(actual, "name", "left").where(
        F.col("actual").isNull() | (F.col("actual") != F.lower("sha256"))
    )


def fingerprint(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Order-free content fingerprint per group, for tables too large for a file checksum."""
    hashed = rows.withColumn("__h", F.xxhash64("id", "embedding"))
    wide = F.col("__h").cast("decimal(20,0)")
    return hashed.groupBy(*(group or [])).agg(
        F.count("*").alias("rows"), F.sum(wide).cast("string").alias("hash_sum"), F.bit_xor("__h").alias("hash_xor")
    )


# --- tables -------------------------------------------------------------------------------


def id_domain(rows: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows"), F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id")
    )


def id_domain_violations(rows: DataFrame, expected_rows: int, id_base: int, id_col: str = "id") -> DataFrame:
    """Row count and id range against the contract."""
    last = id_base + expected_rows - 1
    return id_domain(rows, id_col).where(
        (F.col("rows") != expected_rows)
        | ~F.col("min_id").eqNullSafe(F.lit(id_base))
        | ~F.col("max_id").eqNullSafe(F.lit(last))
    )


def duplicate_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that occur more than once; a hot id is counted before the shuffle."""
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("copies")).where(
        F.col("copies") > 1
    )


def id_gaps(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Density of the id domain: rows, distinct ids and span (one row, empty when dense)."""
    distinct = rows.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("copies"))
    stats = distinct.agg(
        F.sum("copies").alias("rows"),
        F.count("*").alias("distinct_ids"),
        (F.max("id") - F.min("id") + 1).alias("span"),
    )
    return stats.where((F.col("rows") != F.col("distinct_ids")) | (F.col("span") != F.col("distinct_ids")))


def vector_problem(dim: int, vec_col: str = "embedding") -> Column:
    """What is wrong with a vector; NULL when nothing is."""
    return (
        F.when(F.col(vec_col).isNull(), "null vector")
        .when(F.size(vec_col) != dim, "wrong dimension")
        .when(F.exists(vec_col, lambda x: x.isNull()), "null element")
    )


def vector_violations(rows: DataFrame, dim: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Rows with a wrong dimension, a null vector or a null element."""
    found = rows.select(F.col(id_col).alias("id"), vector_problem(dim, vec_col).alias("reason"))
    return found.where(F.col("reason").isNotNull())


def schema_violations(schema: StructType, dim: int | None = None, required: bool = False) -> list[str]:
    """Contract of a vector table: ``id long``, ``embedding list<float>``, dimension metadata.

    ``required``: neither column nor the elements may be nullable. Parquet tables read by Spark never say
    so, whatever they hold; for those leave it out and check the values.
    """
    found = {field.name: field for field in schema.fields}
    problems = []
    if "id" not in found or found["id"].dataType != LongType():
        problems.append("id must be long")
    vector = found.get("embedding")
    if vector is None or not isinstance(vector.dataType, ArrayType):
        problems.append("embedding must be a list")
    elif vector.dataType.elementType != FloatType():
        problems.append("embedding elements must be float")
    if required:
        problems += [f"{name} must be required" for name in ("id", "embedding") if name in found and found[name].nullable]
        if vector is not None and isinstance(vector.dataType, ArrayType) and vector.dataType.containsNull:
            problems.append("embedding elements must be required")
    if dim is not None and vector is not None:
        stated = vector.metadata.get("vector_dim")
        if stated is not None and str(stated) != str(dim):
            problems.append(f"embedding.vector_dim is {stated}, expected {dim}")
    return problems


def bucket_violations(rows: DataFrame, buckets: int, column: str = BUCKET_FIELD) -> DataFrame:
    """Rows whose stored partition value is not ``bucket(id, N)``."""
    checked = with_bucket(rows.select("id", column), "id", buckets, "expected")
    return checked.where(~F.col(column).eqNullSafe(F.col("expected")))


def mixed_files(rows: DataFrame, column: str = BUCKET_FIELD) -> DataFrame:
    """Data files that hold more than one partition value."""
    return (
        rows.groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.min(column).alias("lowest"), F.max(column).alias("highest"))
        .where(~F.col("lowest").eqNullSafe(F.col("highest")))
    )


# --- metadata -----------------------------------------------------------------------------


def metadata_violations(current: DataFrame) -> DataFrame:
    """One row per broken rule of each table: ``(path, rule)``.

    ``current`` comes from ``current_metadata`` and carries the contract's ``dim`` and
    ``buckets`` beside every document.
    """
    vector_type = field_named("embedding")["type"]
    element = F.get_json_object(vector_type, "$.element")
    required = F.get_json_object(vector_type, "$.element-required")
    spec = F.get("spec_fields", F.lit(0))
    transform = F.concat(F.lit("bucket["), F.col("buckets").cast("string"), F.lit("]"))
    bucketed = (
        (F.size("spec_fields") == 1)
        & (spec["source-id"] == 1)
        & (spec["name"] == BUCKET_FIELD)
        & (spec["transform"] == transform)
    )
    field_dim = field_named("embedding")["vector_dim"]
    rules = {
        "format version": F.col("format_version").eqNullSafe(FORMAT_VERSION),
        "snapshot": F.col("snapshot_id").isNotNull(),
        "dimension property": F.col("dim_is_text")
        & F.col("dim_property").eqNullSafe(F.col("dim").cast("string")),
        "field dimension": field_dim.isNull() | (field_dim == F.col("dim").cast("string")),
        "id type": field_named("id")["type"].eqNullSafe(F.lit("long")),
        "vector type": F.get_json_object(vector_type, "$.type").eqNullSafe(F.lit("list")),
        "element type": element.eqNullSafe(F.lit("float")) & required.eqNullSafe(F.lit("true")),
        "partition spec": F.when(F.col("buckets") == 0, F.size("spec_fields") == 0).otherwise(bucketed),
    }
    broken = [
        F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()
    ]
    return current.select("path", F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def head_state(heads: DataFrame, namespace: str, table: str, location: str, snapshot: int) -> DataFrame:
    """``n|matching relation|matching head`` counts of one table's head rows."""
    rows = heads.where((F.col("namespace") == namespace) & (F.col("table_name") == table))
    matches = (F.col("metadata_location") == location) & (F.col("snapshot_id") == snapshot)
    return rows.agg(
        F.count("*").alias("entries"),
        F.sum(F.when(F.col("metadata_location").like("file:///%.metadata.json"), 1).otherwise(0)).alias(
            "local_metadata"
        ),
        F.sum(F.when(matches, 1).otherwise(0)).alias("current"),
    )


def check_vector_files(spark: SparkSession, path: str, width: int, rows: int) -> None:
    """Whole-file gate before a load: lengths first, since they cost no data read."""
    size = record_bytes(width)
    total = file_listing(spark, path).agg(
        F.sum("length").alias("bytes"), F.sum(F.col("length") % size).alias("partial")
    )
    require_empty(
        total.where((F.col("bytes") != rows * size) | (F.col("partial") != 0)), "vector file size"
    )
