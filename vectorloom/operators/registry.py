"""Index registry: definitions, verification, removal, orphan detection.

A registry is a table with one row per index:
``namespace, table_name, table_uuid, name, index_type, implementation, state, partitions``
where ``partitions`` nests segments, their artifact files and algorithm details. An index may be spread over
several such rows: built indexes have one per artifact file, so that no row grows with the index.
Artifacts and files on storage meet on a digest of their path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.text import is_identifier, local_path

# Fixed values: (type, implementation) -> resolved name, artifact prefix.
INDEX_CONTRACTS = [
    ("ivf_flat", "ivf", "builtin.ivf_flat@2", "builtin.ivf_flat_v2_"),
    ("ivf_pq", "ivf_pq", "builtin.ivf_pq@1", "builtin.ivf_pq_v1_"),
    ("btree", "btree", "BTree", None),
]

DETAILS = "struct<dimension:int,num_clusters:int,num_sub_quantizers:int,nbits:int>"
ARTIFACT = "struct<uri:string,size_bytes:bigint>"
SEGMENT = f"struct<artifact_files:array<{ARTIFACT}>,algorithm_details:{DETAILS}>"
REGISTRY_SCHEMA = (
    "namespace string, table_name string, table_uuid string, name string, index_type string, "
    f"implementation string, state string, partitions array<struct<segments:array<{SEGMENT}>>>"
)


def contract_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        INDEX_CONTRACTS,
        "index_type string, implementation string, resolved string, artifact_prefix string",
    )


def resolve_contracts(definitions: DataFrame) -> DataFrame:
    """Add the resolved implementation; pairs outside the contract get NULL."""
    contracts = contract_table(definitions.sparkSession)
    return definitions.join(F.broadcast(contracts), ["index_type", "implementation"], "left")


def definition_violations(definitions: DataFrame, key: list[str]) -> DataFrame:
    """Broken rules per index definition: ``(key…, rule)``.

    Needs ``name, index_type, implementation, num_clusters, sample_rate, workers, dim,
    num_sub_quantizers, nbits``; the last two may be NULL (implementation default).
    """
    positive = ["num_clusters", "sample_rate", "workers", "dim"]
    parts, bits = F.col("num_sub_quantizers"), F.col("nbits")
    rules: dict[str, Column] = {"identifier": is_identifier("name")}
    for name in positive:
        rules[f"{name} positive"] = F.col(name) > 0
    rules["nbits range"] = bits.isNull() | bits.between(1, 8)
    rules["sub-quantizers positive"] = parts.isNull() | (parts > 0)
    rules["sub-quantizers divide dimension"] = (
        parts.isNull() | (parts <= 0) | (F.col("dim") % F.when(parts > 0, parts) == 0)
    )
    rules["known contract"] = F.col("resolved").isNotNull()
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]
    checked = resolve_contracts(definitions)
    return checked.select(*key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def segments(registry: DataFrame) -> DataFrame:
    """One row per segment, index columns kept."""
    kept = [c for c in registry.columns if c != "partitions"]
    parts = registry.select(*kept, F.explode("partitions").alias("partition"))
    return parts.select(*kept, F.inline("partition.segments"))


def artifacts(registry: DataFrame) -> DataFrame:
    """One row per registered artifact file with its decoded ``path``."""
    return (
        segments(registry)
        .select("*", F.explode("artifact_files").alias("file"))
        .drop("artifact_files")
        .withColumn("path", F.coalesce(local_path("file.uri"), "file.uri"))
        .withColumn("size_bytes", F.col("file.size_bytes"))
        .drop("file")
    )


def digest(path) -> Column:
    """Key of a path: 16 bytes, whatever its length."""
    return F.unhex(F.md5(F.col(path) if isinstance(path, str) else path))


def artifact_violations(registry: DataFrame, listing: DataFrame, root: str | None = None) -> DataFrame:
    """Active vector indexes against the files on storage: ``(name, path, problem)``.

    ``listing`` is ``(path, length)``. A file, or a folder it lies in, must bear the prefix of its index's
    contract. With ``root`` every artifact must lie below that folder; a path that climbs does not.
    """
    active = resolve_contracts(registry.where(F.col("state") == "active"))
    vector = active.where(F.col("artifact_prefix").isNotNull())
    filed = artifacts(vector).select("name", "path", "size_bytes", "artifact_prefix", digest("path").alias("key"))
    stored = listing.select(digest("path").alias("key"), "length")
    climbs = F.col("path").rlike(r"/\.\.?(/|$)")
    outside = climbs if root is None else climbs | ~F.col("path").startswith(root.rstrip("/") + "/")
    problem = (
        F.when(outside, "outside")
        .when(~F.contains(F.col("path"), F.concat(F.lit("/"), F.col("artifact_prefix"))), "prefix")
        .when(F.col("length").isNull(), "missing")
        .when(F.col("length") != F.col("size_bytes"), "size")
    )
    found = filed.join(stored, "key", "left").select("name", "path", problem.alias("problem"))
    return found.where(F.col("problem").isNotNull())


def is_index(name: str, table_name: str, namespace: str) -> Column:
    """An index is known by its table and name; the name alone may occur on several tables."""
    key = {"namespace": namespace, "table_name": table_name, "name": name}
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in key.items()])


def active_index_violations(
    registry: DataFrame,
    listing: DataFrame,
    name: str,
    table_name: str,
    namespace: str,
    index_type: str,
    table_uuid: str | None = None,
    root: str | None = None,
    **expected: int,
) -> DataFrame:
    """Everything wrong with one index that should be active: ``(name, path, problem)``.

    ``root``: folder its artifacts must lie in. ``expected`` may state ``dimension``, ``num_clusters``, ``num_sub_quantizers``, ``nbits``.
    """
    spark = registry.sparkSession
    mine = registry.where(is_index(name, table_name, namespace))
    heads = mine.select("table_uuid", "index_type", "implementation", "state").distinct()
    one = heads.agg(F.count("*").alias("n"))

    def rows(frame: DataFrame, problem: Column) -> DataFrame:
        return frame.select(
            F.lit(name).alias("name"), F.lit(None).cast("string").alias("path"), problem.alias("problem")
        )

    found = rows(one.where(F.col("n") != 1), F.format_string("%d entries", F.col("n")))
    found = found.unionByName(rows(mine.where(F.col("state") != "active"), F.lit("state")))
    found = found.unionByName(rows(mine.where(F.col("index_type") != index_type), F.lit("type")))
    resolved = resolve_contracts(mine)
    found = found.unionByName(rows(resolved.where(F.col("resolved").isNull()), F.lit("contract")))
    if table_uuid is not None:
        found = found.unionByName(
            rows(mine.where(F.col("table_uuid") != table_uuid), F.lit("table uuid"))
        )
    details = segments(mine)
    for field, value in expected.items():
        wrong = details.where(~F.col(f"algorithm_details.{field}").eqNullSafe(F.lit(value)))
        found = found.unionByName(rows(wrong, F.lit(field)))
    none = artifacts(mine).agg(F.count("*").alias("n")).where(F.col("n") == 0)
    found = found.unionByName(rows(none, F.lit("no artifacts")))
    return found.unionByName(artifact_violations(mine, listing, root)).distinct()


def distinct_details(registry: DataFrame) -> DataFrame:
    """Different algorithm details in use, as canonical JSON."""
    return segments(registry).select(
        F.to_json("algorithm_details").alias("algorithm_details")
    ).distinct()


def orphans(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Files on storage that no index entry names."""
    known = artifacts(registry).select(digest("path").alias("__key"))
    return listing.withColumn("__key", digest("path")).join(known, "__key", "left_anti").drop("__key")


def removable(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Orphans, but only when no index is left: files of an active index are never offered."""
    if registry.take(1):
        raise ValueError("registry still holds indexes; drop them before looking for residue")
    return listing


def drop_index(registry: DataFrame, name: str, table_name: str, namespace: str) -> DataFrame:
    """Registry without one index of one table."""
    return registry.where(~is_index(name, table_name, namespace))


def activate(registry: DataFrame, name: str, table_name: str, namespace: str) -> DataFrame:
    """Registry with one index of one table set active."""
    state = F.when(is_index(name, table_name, namespace), F.lit("active")).otherwise(F.col("state"))
    return registry.withColumn("state", state)


def entries_named(registry: DataFrame, name: str, table_name: str, namespace: str) -> DataFrame:
    """Residual check after a drop: the count must be 0 (or 1 before it)."""
    return registry.where(is_index(name, table_name, namespace)).agg(F.count("*").alias("entries"))


def head_violations(heads: DataFrame, files: DataFrame) -> DataFrame:
    """Registry heads whose file size, hash or table uuid disagree.

    ``heads``: ``path, file_size_bytes, content_sha256, table_uuid``;
    ``files``: ``path, length, sha256, file_uuid``.
    """
    joined = heads.join(files, "path", "left")
    problem = (
        F.when(F.col("length").isNull(), "missing")
        .when(F.col("length") != F.col("file_size_bytes"), "size")
        .when(F.col("sha256") != F.col("content_sha256"), "hash")
        .when(F.col("file_uuid") != F.col("table_uuid"), "table uuid")
    )
    return joined.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


def stored_artifacts(index) -> tuple[str, DataFrame]:
    """Folder of a built index's artifacts and its files ``(path, length)``, as plain paths."""
    from vectorloom.operators.ivf import LISTS, IvfIndex
    from vectorloom.operators.pq import CODES
    from vectorloom.sources.records import file_listing

    flat = isinstance(index, IvfIndex)
    folder = f"{index.path if flat else index.ivf.path}/{LISTS if flat else CODES}"
    files = file_listing(SparkSession.active(), folder).where(F.col("path").endswith(".parquet"))
    return folder, files.select(F.coalesce(local_path("path"), "path").alias("path"), "length")


def registry_entry(index, name: str, namespace: str, table: str, table_uuid: str) -> DataFrame:
    """Registry rows of a built index: one per artifact file on storage, with the index's details."""
    from vectorloom.operators.ivf import IvfIndex

    flat = isinstance(index, IvfIndex)
    ivf = index if flat else index.ivf
    _, files = stored_artifacts(index)
    parts = None if flat else index.params.num_sub_quantizers
    bits = None if flat else index.params.nbits
    details = F.struct(
        F.lit(ivf.dim).alias("dimension"),
        F.lit(ivf.num_lists).alias("num_clusters"),
        F.lit(parts).cast("int").alias("num_sub_quantizers"),
        F.lit(bits).cast("int").alias("nbits"),
    )
    artifact = F.array(F.struct(F.col("path").alias("uri"), F.col("length").alias("size_bytes")))
    segment = F.struct(artifact.alias("artifact_files"), details.alias("algorithm_details"))
    kind = ("ivf_flat", "ivf") if flat else ("ivf_pq", "ivf_pq")
    return files.select(
        F.lit(namespace).alias("namespace"),
        F.lit(table).alias("table_name"),
        F.lit(table_uuid).alias("table_uuid"),
        F.lit(name).alias("name"),
        F.lit(kind[0]).alias("index_type"),
        F.lit(kind[1]).alias("implementation"),
        F.lit("active").alias("state"),
        F.array(F.struct(F.array(segment).alias("segments"))).cast(f"array<struct<segments:array<{SEGMENT}>>>").alias("partitions"),
    )
