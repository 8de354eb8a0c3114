"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, … and share the size of the
whole corpus by weight. No source gives more than ``most_copies`` times its size; what a
source cannot give is shared again by weight among the others. With ``share = t * weight`` this
is the ``t`` for which the capped shares add up to the total, found with one sorted pass over
the sources (a table with a row per source).

A source's documents are laid out in order of size (then id), each as long as its expected
number of copies, ``target / source size``. One offset is added, and a document is taken once
per integer boundary that it crosses. As neighbours are of like size, the words taken differ
from the target by no more than about the largest document. That is much for a source of a few
dozen documents, so ``DRAWS`` offsets are drawn from digests of seed and source, and the one
whose taken words come nearest to the target is used.

A source may hold a third of all rows, so ranks come from range partitions of (source, size,
id): rows are numbered inside their partition, and the counts of the partitions before are
added. The ranged rows are written down once, since both steps must see the same partitions.

Defined cases: a null text has size 0; a null source is a source of its own, an empty one too;
documents of size 0 may be taken, adding nothing; a source of size 0 has target 0; repeated
rows are documents of their own; an empty table gives no rows; in :func:`take` further columns
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.columns import col, fresh, row_key, word_count
from vectorloom.session import materialize, split_count

#: Fixed values of the mix.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def targets(sized: DataFrame, weights=WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """``(source, source_size, target)`` from rows with ``source`` and ``size``."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))))
    weighed = sources.withColumn("w", weight.cast("double")).withColumn("cap", (most_copies * F.col("source_size")).cast("double"))
    # Sources that reach their cap first come first; k of them are capped.
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = weighed.select(
        "*",
        (
            (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        ).alias("level"),
    )
    # The first source whose cap is not reached at the level that it would set, sets it.
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    everywhere = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return filled.withColumn("level", F.first(fits, ignorenulls=True).over(everywhere)).select(
        "source",
        "source_size",
        F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"),
    )


#: Offsets drawn per source.
DRAWS = 32


def offset_of(source: Column, seed: int, draw: int) -> Column:
    """A number in [0, 1) per source and draw, the same in every run."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))
    digest = F.md5(F.concat(F.lit(f"{seed}:{draw}:"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def crossings(rank: Column, rate: Column, offset: Column) -> Column:
    """Integer boundaries inside ``[rank * rate, (rank + 1) * rate) + offset``."""
    return F.least(F.floor((rank + 1) * rate + offset) - F.floor(rank * rate + offset), F.lit(MOST_COPIES))


def mix(
    docs: DataFrame,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)`` and the columns in ``keep``, which
    come in one struct ``row``.
    """
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"),
        col(source_col).cast("string").alias("source"),
        F.coalesce(word_count(col(text_col)), F.lit(0)).cast("long").alias("size"),
        *([F.struct(*map(col, keep)).alias("row")] if keep else []),
    )
    # As many ranges as the input has splits, so that no range outgrows a task.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), split_count(rows))
    ranged = materialize(
        rows.repartitionByRange(parts, "source", "size", "doc_id").withColumn("part", F.spark_partition_id()),
        "ranged",
    )
    sums = ranged.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    goal = targets(sums)
    # One row per source and partition: the rows of the source in the partitions before.
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first")
    )
    plan = (
        starts.alias("s")
        .join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
        .select(
            F.col("s.source").alias("of"), F.col("part").alias("in_part"), "first", "source_size", "target",
            F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES))))
            .otherwise(F.lit(0.0)).alias("rate"),
        )
    )
    inside = Window.partitionBy("part", "source").orderBy("size", "doc_id")

    def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
        ranked = rows.withColumn("at", F.row_number().over(inside) - 1)
        on_part = (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of"))
        return ranked.join(plan, on_part).withColumn("rank", F.col("first") + F.col("at"))

    # Words that each of the offsets would take, added up per source.
    rank, rate = F.col("rank"), F.col("rate")
    tried = placed(ranged.select("source", "size", "doc_id", "part"), plan).groupBy("source").agg(
        F.first("target").alias("target"),
        *[
            F.sum(F.col("size") * crossings(rank, rate, offset_of(F.col("source"), seed, d))).alias(f"taken_{d}")
            for d in range(DRAWS)
        ],
    )
    misses = F.array(*[F.abs(F.col(f"taken_{d}") - F.col("target")) for d in range(DRAWS)])
    offsets = F.array(*[offset_of(F.col("source"), seed, d) for d in range(DRAWS)])
    nearest = tried.select(
        F.col("source").alias("chosen"),
        F.get(offsets, F.array_position(misses, F.array_min(misses)).cast("int") - 1).alias("offset"),
    )
    chosen = plan.join(nearest, F.col("of").eqNullSafe(F.col("chosen")))
    return placed(ranged, chosen).select(
        "doc_id", "source", "size", "source_size", "target",
        crossings(rank, rate, F.col("offset")).cast("long").alias("copies"),
        *(["row"] if keep else []),
    )


def take(docs: DataFrame, seed: int = 0, **columns: str) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of ``docs``.

    Copies are counted without the texts and joined to them by a digest of the row. Rows alike
    in every column are one row here, taken as often as all of them together.
    """
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs))
    copies = mix(keyed, seed, keep=[key], **columns).groupBy(F.col("row")[key].alias("taken")).agg(
        F.sum("copies").cast("int").alias("n")
    )
    joined = keyed.join(copies.where(F.col("n") > 0), col(key) == F.col("taken"))
    first = joined.withColumn("taken", F.row_number().over(Window.partitionBy(key).orderBy(key))).where("taken = 1")
    repeated = first.withColumn("taken", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return repeated.select(*map(col, docs.columns))
