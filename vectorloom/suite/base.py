"""Registration and the inputs several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIM = 64
K = 10


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is the same result in plain SQL."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a vector table ``(id, embedding)``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_index"), F.col("embedding").alias("qvec")
    )


def neighbours(found: DataFrame) -> DataFrame:
    """Result shape of the searches, with types and rounding both engines agree on."""
    return found.select(
        "query_index",
        F.col("rk").cast("long").alias("rk"),
        "id",
        F.round("dist", 6).alias("dist"),
    )


# Exact top-k of every vector against every vector.
EXACT_CTE = """
e AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
exact AS MATERIALIZED (
  SELECT * FROM (
    SELECT q.id AS query_index, b.id AS id, list_distance(q.v, b.v) AS dist,
           row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, b.v), b.id) AS rk
    FROM e q, e b)
  WHERE rk <= 10)
"""
