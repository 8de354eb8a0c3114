"""Table metadata documents, dataset contracts and benchmark result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vectorloom.functions.text import metadata_version

# Fixed values of the table contract.
DIM_PROPERTY = "vector_dim.embedding"
BUCKET_FIELD = "id_bucket"
FORMAT_VERSION = 2

# Name, dimension, rows, queries, ground-truth width, buckets, id base.
DATASET_CONTRACTS = [
    ("sift1m", 128, 1_000_000, 10_000, 100, 32, 1),
    ("gist1m", 960, 1_000_000, 1_000, 100, 32, 1),
]
# Which producer may load which dataset.
DATASET_PROVIDERS = [
    ("sift1m", "spark"),
    ("sift1m", "pyiceberg"),
    ("sift1m", "rust"),
    ("gist1m", "pyiceberg"),
]

SPEC_FIELD = "struct<`source-id`:int,`field-id`:int,name:string,transform:string>"
SCHEMA_FIELD = "struct<id:int,name:string,required:boolean,type:string,vector_dim:string>"
SCHEMA_TYPE = f"struct<`schema-id`:int,fields:array<{SCHEMA_FIELD}>>"
METADATA_SCHEMA = (
    "`format-version` int, `table-uuid` string, location string, `current-snapshot-id` string, "
    f"`current-schema-id` int, schemas array<{SCHEMA_TYPE}>, schema {SCHEMA_TYPE}, "
    "`default-spec-id` int, "
    f"`partition-specs` array<struct<`spec-id`:int,fields:array<{SPEC_FIELD}>>>, "
    f"`partition-spec` array<{SPEC_FIELD}>, properties map<string,string>"
)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents ``(path, document)``; one row per metadata file."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def current_metadata(documents: DataFrame) -> DataFrame:
    """Schema and partition spec in force, picked by id; ``dim_is_text`` is false for a number.

    Keeps every column of ``documents`` beside the parsed ones.
    """
    doc = F.from_json("document", METADATA_SCHEMA)
    parsed = documents.withColumn("doc", doc)
    wanted = F.coalesce(F.col("doc.current-schema-id"), F.col("doc.schema.schema-id"))
    known = F.coalesce(F.col("doc.schemas"), F.array("doc.schema"))
    by_id = F.filter(known, lambda s: s["schema-id"].eqNullSafe(wanted))
    schema = F.when(F.size(by_id) > 0, F.get(by_id, F.lit(0))).when(
        F.size(known) == 1, F.get(known, F.lit(0))
    )
    spec_id = F.coalesce(F.col("doc.default-spec-id"), F.lit(0))
    specs = F.filter("doc.partition-specs", lambda s: s["spec-id"] == spec_id)
    fields = F.when(
        F.col("doc.partition-specs").isNotNull(), F.get(specs, F.lit(0))["fields"]
    ).otherwise(F.col("doc.partition-spec"))
    # The raw JSON token tells "128" from 128, which a string-typed schema would hide.
    raw_dim = F.regexp_extract("document", r'"vector_dim\.embedding"\s*:\s*("?)', 1)
    return parsed.select(
        *documents.columns,
        F.col("doc.format-version").alias("format_version"),
        F.col("doc.table-uuid").alias("table_uuid"),
        F.col("doc.location").alias("location"),
        F.col("doc.current-snapshot-id").try_cast("long").alias("snapshot_id"),
        schema["fields"].alias("fields"),
        F.coalesce(fields, F.array().cast(f"array<{SPEC_FIELD}>")).alias("spec_fields"),
        F.col("doc.properties")[DIM_PROPERTY].alias("dim_property"),
        (raw_dim == '"').alias("dim_is_text"),
        F.col("doc.properties").alias("properties"),
    )


def field_named(name: str) -> Column:
    return F.get(F.filter("fields", lambda f: f["name"] == name), F.lit(0))


def latest_metadata(listing: DataFrame, group: list[str], path: str = "path", hint: str = "hint") -> DataFrame:
    """Current metadata file per table: the hinted version if present, else the highest number.

    ``listing`` has one row per file, ``hint`` holding the table's hinted version or NULL.
    """
    version = metadata_version(path)
    numbered = listing.withColumn("version", version).where(F.col("version").isNotNull())
    hinted = F.coalesce(F.col("version") == F.col(hint), F.lit(False))
    return numbered.groupBy(*group).agg(
        F.max_by(F.col(path), F.struct(hinted, F.col("version"))).alias("path"),
        F.max(F.struct(hinted, F.col("version")))["version"].alias("version"),
    )


def contract_table(spark: SparkSession, contracts=None) -> DataFrame:
    """Dataset contracts as a table for joins; strings where the audit compares strings."""
    names = ["dataset", "dim", "rows", "queries", "gt_width", "buckets", "id_base"]
    schema = StructType(
        [StructField(names[0], StringType(), False)]
        + [StructField(n, LongType(), False) for n in names[1:]]
    )
    return spark.createDataFrame(contracts or DATASET_CONTRACTS, schema)


def provider_table(spark: SparkSession, providers=None) -> DataFrame:
    return spark.createDataFrame(providers or DATASET_PROVIDERS, "dataset string, provider string")


def unsupported_requests(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Requested (dataset, provider) pairs that no reader serves."""
    return requests.join(F.broadcast(providers), ["dataset", "provider"], "left_anti")


def read_results(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Scenario results: one (indented) document per file, or one per line as Spark writes."""
    return spark.read.option("multiLine", str(one_per_file).lower()).json(path)
