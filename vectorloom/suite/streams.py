"""Streaming ingest and index maintenance, run to completion over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.session import new_workdir
from vectorloom.streaming import ingest as streaming
from vectorloom.suite.base import DIM, query, vectors
from vectorloom.suite.index import BUCKET_CTE, IVF_CTE, PQ_CTE, _E_CTE, ivf_index, pq_index
from vectorloom.suite.layout import LAYOUT_SQL, vector_total


def arriving(spark, sf_dir) -> str:
    """The vector table split over several files, as a stream would find it."""
    path = new_workdir(spark, "arriving")
    vectors(spark, sf_dir).repartitionByRange(4, "id").write.parquet(path)
    return path


@query("stream_ingest", LAYOUT_SQL)
def stream_ingest(spark, sf_dir):
    root = new_workdir(spark, "stream")
    stream = streaming.vector_stream(spark, arriving(spark, sf_dir), files_per_batch=2)
    streaming.ingest(
        stream, f"{root}/table", f"{root}/rejects", f"{root}/checkpoint", DIM, 32
    ).awaitTermination()
    return spark.read.parquet(f"{root}/table").select("id", "id_bucket", vector_total())


@query(
    "stream_rejects",
    """
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'null vector' WHEN vec_id % 5 = 0 THEN 'wrong dimension'
      ELSE 'null element' END AS reason,
      CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN 63 ELSE 64 END AS size
    FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 5 = 0 OR vec_id % 3 = 0
    """,
)
def stream_rejects(spark, sf_dir):
    """Damaged vectors among the arriving ones are set aside whole, with the reason."""
    root, arrived, key = new_workdir(spark, "stream"), new_workdir(spark, "arriving"), F.col("id")
    none = F.lit(None).cast("float")
    damaged = (
        F.when(key % 7 == 0, F.lit(None).cast("array<float>"))
        .when(key % 5 == 0, F.slice("embedding", 1, DIM - 1))
        .when(key % 3 == 0, F.concat(F.slice("embedding", 1, DIM - 1), F.array(none)))
        .otherwise(F.col("embedding"))
    )
    rows = vectors(spark, sf_dir).withColumn("embedding", damaged)
    rows.repartitionByRange(4, "id").write.parquet(arrived)
    stream = streaming.vector_stream(spark, arrived, files_per_batch=2)
    streaming.ingest(
        stream, f"{root}/table", f"{root}/rejects", f"{root}/checkpoint", DIM, 32
    ).awaitTermination()
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return spark.read.parquet(f"{root}/rejects").select("id", "reason", size.alias("size"))


@query(
    "stream_assign",
    f"WITH {_E_CTE}, {IVF_CTE} SELECT id, CAST(list_id AS INT) AS list_id FROM assigned",
)
def stream_assign(spark, sf_dir):
    """Arriving vectors put into the lists of a frozen index."""
    root = new_workdir(spark, "stream")
    stream = streaming.vector_stream(spark, arriving(spark, sf_dir), files_per_batch=2)
    streaming.append_lists(
        stream, ivf_index(spark, sf_dir), f"{root}/lists", f"{root}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{root}/lists").select("id", "list_id")


@query(
    "stream_encode",
    f"""
    WITH {_E_CTE}, {IVF_CTE}, {PQ_CTE}, {BUCKET_CTE}
    SELECT k.id, b.id_bucket, string_agg(CAST(code AS VARCHAR), ',' ORDER BY m) AS codes
    FROM codes k JOIN bucket b USING (id) GROUP BY ALL
    """,
)
def stream_encode(spark, sf_dir):
    root = new_workdir(spark, "stream")
    stream = streaming.vector_stream(spark, arriving(spark, sf_dir), files_per_batch=2)
    coded = streaming.encoded_stream(stream, pq_index(spark, sf_dir))
    (
        coded.writeStream.format("parquet")
        .option("path", f"{root}/codes")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    text = F.array_join(F.transform("codes", lambda x: x.cast("string")), ",")
    return spark.read.parquet(f"{root}/codes").select("id", "id_bucket", text.alias("codes"))
