"""Session helpers: shared working folder, written intermediates, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MIB = 1024 * 1024

#: Ceiling for anything shipped to every task (query vectors, centroids, codebooks).
BROADCAST_LIMIT_BYTES = 64 * MIB


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: there driver and
    executors are one machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="vectorloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_workdir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Cut lineage by one write to the shared folder; the result is read back from there.

    The files outlive any executor, and unlike ``checkpoint()`` the input runs only once.
    """
    path = new_workdir(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fetch_bounded(df: DataFrame, max_rows: int):
    """Arrow table of ``df`` when it has at most ``max_rows`` rows, else ``None``."""
    table = df.limit(max_rows + 1).toArrow()
    return None if table.num_rows > max_rows else table


def split_count(df: DataFrame) -> int:
    """Number of input tasks the physical plan of ``df`` would start."""
    return df.rdd.getNumPartitions()
