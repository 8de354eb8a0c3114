"""Vector tables on storage: layouts, appends, audits, published versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from vectorloom.functions.bucket import check_buckets, with_bucket
from vectorloom.functions.text import IDENTIFIER_PATTERN
from vectorloom.session import materialize
from vectorloom.sources.records import file_listing

# Codecs a producer may write.
COMPRESSIONS = {
    "spark": ("uncompressed", "zstd", "snappy", "lz4"),
    "pyiceberg": ("uncompressed", "zstd", "snappy", "gzip"),
}
TARGET_FILE_BYTES = 1 << 30
#: Bytes a writing task should hold; small tables still get a task per few MiB, as far as there are cores.
WRITE_TASK_BYTES, SMALL_TASK_BYTES = 256 << 20, 4 << 20
DEFAULT_BUCKETS = 32
DEFAULT_BATCH_ROWS = 131_072


def vector_schema(dim: int) -> StructType:
    """``id long, embedding list<float>``, both required; the dimension is field metadata."""
    return StructType(
        [
            StructField("id", LongType(), False),
            StructField(
                "embedding", ArrayType(FloatType(), containsNull=False), False, {"vector_dim": dim}
            ),
        ]
    )


def check_identifier(value: str, what: str = "identifier") -> str:
    if not re.fullmatch(IDENTIFIER_PATTERN, value):
        raise ValueError(f"{what} may hold only a-z, 0-9 and _: {value!r}")
    return value


def check_compression(codec: str, provider: str = "spark") -> str:
    if provider not in COMPRESSIONS:
        raise ValueError(f"unknown provider {provider!r}")
    if codec not in COMPRESSIONS[provider]:
        raise ValueError(f"{provider} cannot write {codec!r}")
    return codec


def table_path(warehouse: str, namespace: str, table: str) -> str:
    check_identifier(namespace, "namespace")
    check_identifier(table, "table")
    return f"{warehouse.rstrip('/')}/{namespace}/{table}"


def rows_per_file(dim: int, target_bytes: int = TARGET_FILE_BYTES) -> int:
    return max(1, target_bytes // (4 * dim + 8))


def estimated_bytes(rows: DataFrame) -> int:
    """Uncompressed size of a table: its counted rows times the width of its first row's vector and columns."""
    if "embedding" not in rows.columns:
        return rows.count() * 16 * len(rows.columns)
    head = rows.select(F.size("embedding").alias("dim")).head()
    return rows.count() * (8 * (len(rows.columns) - 1) + 4 * head.dim) if head else 0


def writing_tasks(rows: DataFrame) -> int:
    """Tasks that write a table of this size."""
    size, cores = estimated_bytes(rows), rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // WRITE_TASK_BYTES), min(cores, -(-size // SMALL_TASK_BYTES)))


def write_bucketed(
    rows: DataFrame,
    path: str,
    buckets: int = DEFAULT_BUCKETS,
    dim: int | None = None,
    writers_per_bucket: int | None = None,
    compression: str = "uncompressed",
    mode: str = "errorifexists",
    target_file_bytes: int = TARGET_FILE_BYTES,
) -> None:
    """Hash layout ``bucket(id, N)``: every file holds one bucket, rows ordered by id.

    ``writers_per_bucket`` splits a bucket over several tasks where one would be too large; by default the
    size of the table says how many. With ``dim``, files end at ``target_file_bytes``.
    """
    check_buckets(buckets)
    check_compression(compression)
    if writers_per_bucket is None:
        writers_per_bucket = max(1, -(-estimated_bytes(rows) // (buckets * WRITE_TASK_BYTES)))
    spread = F.pmod(F.xxhash64("id"), F.lit(writers_per_bucket))
    placed = with_bucket(rows, "id", buckets).withColumn("__writer", spread)
    writer = (
        placed.repartition(buckets * writers_per_bucket, "id_bucket", "__writer")
        .sortWithinPartitions("id_bucket", "id")
        .drop("__writer")
        .write.mode(mode)
        .option("compression", compression)
        .partitionBy("id_bucket")
    )
    if dim:
        writer = writer.option("maxRecordsPerFile", rows_per_file(dim, target_file_bytes))
    writer.parquet(path)


def write_unpartitioned(
    rows: DataFrame,
    path: str,
    data_files: int | None = None,
    compression: str = "uncompressed",
    mode: str = "errorifexists",
) -> None:
    """No partition column; rows hashed over ``data_files`` files (default: by size), ordered by id in each."""
    data_files = writing_tasks(rows) if data_files is None else data_files
    if data_files < 1:
        raise ValueError("data_files must be positive")
    check_compression(compression)
    rows.repartition(data_files, "id").sortWithinPartitions("id").write.mode(mode).option(
        "compression", compression
    ).parquet(path)


def write_id_clustered(
    rows: DataFrame,
    path: str,
    data_files: int | None = None,
    compression: str = "uncompressed",
    id_col: str = "id",
    mode: str = "errorifexists",
) -> None:
    """Range layout: file and row-group min/max let id lookups skip nearly all data."""
    check_compression(compression)
    data_files = writing_tasks(rows) if data_files is None else data_files
    rows.repartitionByRange(data_files, id_col).sortWithinPartitions(id_col).write.mode(mode).option(
        "compression", compression
    ).parquet(path)


def create_table(
    rows: DataFrame, path: str, buckets: int = DEFAULT_BUCKETS, data_files: int | None = None, **options
) -> None:
    """Refuses an existing table; ``buckets=0`` gives the unpartitioned layout."""
    if buckets < 0:
        raise ValueError(f"bucket count must not be negative, got {buckets}")
    if buckets:
        write_bucketed(rows, path, buckets, **options)
    else:
        write_unpartitioned(rows, path, data_files, **options)


def write_catalog_table(
    rows: DataFrame, identifier: str, buckets: int, properties: dict[str, str], source: str = "iceberg"
) -> None:
    """Same table through a V2 catalog of the session, when one is configured."""
    for part in identifier.split("."):
        check_identifier(part)
    writer = rows.writeTo(identifier).using(source)
    for name, value in properties.items():
        writer = writer.tableProperty(name, value)
    if buckets:
        writer = writer.partitionedBy(F.partitioning.bucket(buckets, "id"))
    writer.create()


def batch_ranges(spark: SparkSession, total: int, batch_rows: int = DEFAULT_BATCH_ROWS) -> DataFrame:
    """Append batches ``(batch_no, first, rows)``; the last one takes what remains."""
    if batch_rows < 1:
        raise ValueError("batch_rows must be positive")
    return spark.range(-(-total // batch_rows)).select(
        F.col("id").alias("batch_no"),
        (F.col("id") * batch_rows).alias("first"),
        F.least(F.lit(batch_rows).cast("long"), F.lit(total) - F.col("id") * batch_rows).alias("rows"),
    )


def append_in_batches(
    rows: DataFrame, path: str, total: int, id_base: int, batch_rows: int, buckets: int
) -> int:
    """Append id ranges one after another; each append is a new version of the table.

    The input is read once and dealt to one folder per batch; an append reads its folder only.
    """
    number = F.floor((F.col("id") - id_base) / batch_rows).alias("batch_no")
    wanted = rows.where(F.col("id").between(id_base, id_base + total - 1)).select("*", number)
    staged = materialize(wanted.repartition("batch_no"), "batches", "batch_no")
    batches = 0
    for batch in range(-(-total // batch_rows)):
        part = staged.where(F.col("batch_no") == batch).drop("batch_no")
        if buckets:
            write_bucketed(part, path, buckets, mode="append")
        else:
            write_unpartitioned(part, path, mode="append")
        batches += 1
    return batches


def load_audit(spark: SparkSession, path: str, provider: str, buckets: int) -> DataFrame:
    """One row: provider, rows, buckets, data files and bytes."""
    data = file_listing(spark, path).where(F.col("path").endswith(".parquet"))
    files = data.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    rows = spark.read.parquet(path).agg(F.count("*").alias("rows"))
    one = F.lit(1).alias("one")
    return (
        files.select("*", one)
        .join(rows.select("*", one), "one")
        .select(
            F.lit(provider).alias("provider"), "rows", F.lit(buckets).alias("buckets"), "files", "bytes"
        )
    )


def publish(
    spark: SparkSession, pointer_path: str, namespace: str, table: str, location: str, version: int
) -> None:
    """Record a finished version as head; earlier entries stay for readers that hold them."""
    check_identifier(namespace, "namespace")
    check_identifier(table, "table")
    spark.createDataFrame(
        [(namespace, table, location, version)],
        "namespace string, table_name string, location string, version long",
    ).write.mode("append").parquet(pointer_path)


def head_of(spark: SparkSession, pointer_path: str) -> DataFrame:
    """Current version of every table: ``(namespace, table_name, location, version)``."""
    return (
        spark.read.parquet(pointer_path)
        .groupBy("namespace", "table_name")
        .agg(F.max_by("location", "version").alias("location"), F.max("version").alias("version"))
    )


def read_head(spark: SparkSession, pointer_path: str, namespace: str, table: str) -> DataFrame:
    """Scan a table at its current version."""
    rows = head_of(spark, pointer_path).where(
        (F.col("namespace") == namespace) & (F.col("table_name") == table)
    ).take(2)
    if len(rows) != 1:
        raise ValueError(f"{namespace}.{table} has {len(rows)} published heads")
    return spark.read.parquet(rows[0].location)
