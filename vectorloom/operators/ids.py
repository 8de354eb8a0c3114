"""Dense ids for tables that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.session import materialize

#: Copies of one row that are numbered by one task.
CHUNK = 1_000_000


def row_digest(df: DataFrame):
    """128-bit digest of all columns, NULL told apart from every value."""
    shown = [F.coalesce(F.concat(F.lit("="), F.to_json(F.struct(F.col(f"`{c}`")))), F.lit("0")) for c in df.columns]
    return F.md5(F.concat_ws("\x1f", *shown).cast("binary"))


def dense_ids(df: DataFrame, order: list[str], name: str = "id", first: int = 0) -> DataFrame:
    """``df`` with ids ``first … first + rows - 1`` in the order of ``order``, ties by a digest of the row.

    The ids depend on the content alone: not on files, partitions or the tasks that ran twice. Equal rows are
    counted first, so however many copies a row has they are one row in the sort, and take the next ids between
    them. Rows are numbered inside range partitions after the totals of the partitions before; no task sees all
    rows. Columns must be of types that can be grouped by.
    """
    if name in df.columns:
        raise ValueError(f"the table has a column {name!r}")
    columns = [f"`{c}`" for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count("*").alias("__n")).withColumn("__digest", row_digest(df))
    ranged = counted.repartitionByRange(*[f"`{c}`" for c in order], "__digest")
    ranged = materialize(ranged.withColumn("__slice", F.spark_partition_id()), "ids")
    # One row per partition.
    before = W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("__slice").agg(F.sum("__n").alias("rows"))
    offsets = totals.select("__slice", (F.coalesce(F.sum("rows").over(before), F.lit(0)) + first).alias("__first"))
    inside = W.partitionBy("__slice").orderBy(*[f"`{c}`" for c in order], "__digest").rowsBetween(W.unboundedPreceding, -1)
    numbered = ranged.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(offsets, "__slice")
    begun = numbered.select(*columns, (F.col("__first") + F.col("__before")).alias("__from"), "__n")

    def copies(start, count):
        return F.sequence(start, start + count - 1)

    few = begun.where(F.col("__n") <= CHUNK).select(*columns, F.explode(copies(F.col("__from"), F.col("__n"))).alias(name))
    chunks = F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {CHUNK}"))
    dealt = begun.where(F.col("__n") > CHUNK).withColumn("__chunk", F.explode(chunks)).repartition("__from", "__chunk")
    start = F.col("__from") + F.col("__chunk") * CHUNK
    size = F.least(F.lit(CHUNK), F.col("__n") - F.col("__chunk") * CHUNK)
    many = dealt.select(*columns, F.explode(copies(start, size)).alias(name))
    return few.unionByName(many)
