"""Deterministic sampling of ordinals ``0 .. total-1``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check_sample(total: int, count: int) -> None:
    if not 1 <= count <= total:
        raise ValueError(f"sample size must lie in 1..{total}, got {count}")


def equidistant_position(ordinal, total: int, count: int) -> Column:
    """Position of ``ordinal`` in the equidistant sample, NULL when it is not sampled.

    The sample holds ``i*(total-1) div (count-1)`` for ``i`` in ``0..count-1``. The smallest
    ``i`` reaching an ordinal has a closed form, so membership is a plain predicate:
    no id list, no join, and it runs inside the scan stage.
    """
    check_sample(total, count)
    ordinal = (F.col(ordinal) if isinstance(ordinal, str) else ordinal).cast("bigint")
    if count == 1 or total == 1:
        return F.when(ordinal == 0, F.lit(0).cast("bigint"))
    span, steps = F.lit(total - 1).cast("bigint"), F.lit(count - 1).cast("bigint")
    scaled = ordinal * steps
    lower = F.call_function("div", scaled, span)
    position = F.when(scaled % span == 0, lower).otherwise(lower + 1)
    reached = F.call_function("div", position * span, steps)
    return F.when((ordinal >= 0) & (ordinal < total) & (reached == ordinal), position)


def first_position(ordinal, total: int, count: int) -> Column:
    """Position of ``ordinal`` in the first-``count`` sample, NULL when outside."""
    check_sample(total, count)
    ordinal = (F.col(ordinal) if isinstance(ordinal, str) else ordinal).cast("bigint")
    return F.when((ordinal >= 0) & (ordinal < count), ordinal)


def sample_position(ordinal, total: int, count: int, sampling: str) -> Column:
    if sampling == "first":
        return first_position(ordinal, total, count)
    if sampling == "equidistant":
        return equidistant_position(ordinal, total, count)
    raise ValueError(f"unknown sampling {sampling!r}; use first or equidistant")


def sample_ordinals(spark: SparkSession, total: int, count: int, sampling: str) -> DataFrame:
    """Table ``(position, ordinal)`` of the sampled ordinals."""
    check_sample(total, count)
    positions = spark.range(count).withColumnRenamed("id", "position")
    if sampling == "first":
        return positions.select("position", F.col("position").alias("ordinal"))
    if sampling != "equidistant":
        raise ValueError(f"unknown sampling {sampling!r}; use first or equidistant")
    if count == 1:
        return positions.select("position", F.lit(0).cast("bigint").alias("ordinal"))
    ordinal = F.call_function("div", F.col("position") * (total - 1), F.lit(count - 1).cast("bigint"))
    return positions.select("position", ordinal.alias("ordinal"))
