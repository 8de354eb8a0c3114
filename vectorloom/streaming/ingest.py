"""Incremental loading and index maintenance with Structured Streaming."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectorloom.functions.bucket import with_bucket
from vectorloom.operators.ivf import IvfIndex, nearest_list
from vectorloom.operators.pq import PqIndex, encoded
from vectorloom.operators.quality import vector_problem

VECTOR_STREAM = "id long, embedding array<float>"


def vector_stream(
    spark: SparkSession, path: str, files_per_batch: int = 1000, schema: str = VECTOR_STREAM
) -> DataFrame:
    """New vector files below ``path`` as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def ingest(
    stream: DataFrame, table: str, rejects: str, checkpoint: str, dim: int, buckets: int
) -> StreamingQuery:
    """Append good vectors to the bucketed table, the others with a ``reason`` to ``rejects``.

    A micro-batch is read once and kept on the executors' disks for its two writes. Every micro-batch owns the folders ``batch=N`` and overwrites them when it is replayed, so
    a batch that is retried after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = batch.withColumn("reason", vector_problem(dim)).persist(StorageLevel.DISK_ONLY)
        try:
            bad = checked.where(F.col("reason").isNotNull())
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
            good = checked.where(F.col("reason").isNull()).drop("reason")
            placed = with_bucket(good, "id", buckets)
            (
                placed.repartition(buckets, "id_bucket")
                .write.mode("overwrite")
                .partitionBy("id_bucket")
                .parquet(f"{table}/batch={number}")
            )
        finally:
            checked.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def assigned_stream(stream: DataFrame, index: IvfIndex) -> DataFrame:
    """Inverted list of every arriving vector against frozen centroids."""
    if index.centroids is None:
        raise ValueError("a stream needs centroids that can be shipped; assign the batches of a tree by foreachBatch")
    return stream.withColumn("list_id", nearest_list(index.centroids))


def encoded_stream(stream: DataFrame, index: PqIndex) -> DataFrame:
    """List and product-quantization codes of every arriving vector."""
    listed = assigned_stream(stream, index.ivf)
    coded = encoded(listed, index.ivf, index.codebooks)
    return with_bucket(coded.select("id", "list_id", "codes"), "id", index.params.buckets)


def append_lists(stream: DataFrame, index: IvfIndex, path: str, checkpoint: str) -> StreamingQuery:
    """Grow the inverted lists of an index with arriving vectors."""
    return (
        assigned_stream(stream, index)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("list_id")
        .trigger(availableNow=True)
        .start()
    )
