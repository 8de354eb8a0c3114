"""Line-oriented inputs: settings files and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.functions.text import (
    QUERY_BEGIN_PATTERN,
    QUERY_END_PATTERN,
    ROW_ID_PATTERN,
    TIME_PATTERN,
    setting_key_value,
    strip,
)
from vectorloom.session import split_count

#: Lines a written file should hold, and files written at least.
FILE_LINES = 1_000_000
MIN_FILES = 8
#: Tasks that sort the lines of one input split.
SORTS_PER_SPLIT = 4


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, chunk, seq, line)``: line order without numbering the whole file.

    ``chunk`` is the byte offset of the input split a line came from and ``seq`` grows within
    it, so (chunk, seq) is the order in the file while splits are read in parallel.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )


def write_lines(lines: DataFrame, path: str, whole: list[str], order: list[str]) -> None:
    """The column ``line`` as text files, ordered by ``whole`` and ``order``.

    Rows alike in ``whole`` stay in one file; files are as many as the number of lines asks for, so a task
    sorts a bounded share of them.
    """
    files = max(MIN_FILES, -(-lines.count() // FILE_LINES))
    placed = lines.repartitionByRange(files, *whole).sortWithinPartitions(*whole, *order)
    placed.select("line").write.text(path)


def settings(lines: DataFrame) -> DataFrame:
    """Last value of every key per file: ``(file, key, value)``."""
    pairs = lines.withColumn("pair", setting_key_value("line")).where(F.col("pair").isNotNull())
    return (
        pairs.groupBy("file", F.col("pair.key").alias("key"))
        .agg(F.max_by("pair.value", F.struct("chunk", "seq")).alias("value"))
    )


def settings_maps(lines: DataFrame) -> DataFrame:
    """One ``map<string,string>`` per file, for lookups with defaults."""
    return (
        settings(lines)
        .groupBy("file")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))
    )


def query_lines(lines: DataFrame, wanted: Column) -> DataFrame:
    """The ``wanted`` lines between a begin and the next end marker, tagged with their ``query_no``.

    The open query is carried forward inside each chunk and, through one small row per chunk,
    from chunk to chunk: no task ever sorts a whole file. Other lines are left out before the shuffle, and
    the tasks that sort follow the input splits: names of files compress so well that tasks merged by
    their shuffled bytes would hold very many lines.
    """
    text = strip("line")
    begin = F.regexp_extract(text, QUERY_BEGIN_PATTERN, 1)
    marker = F.when(F.length(begin) > 0, begin.cast("long")).when(
        text.rlike(QUERY_END_PATTERN), F.lit(-1).cast("long")
    )
    marked = lines.select("file", "chunk", "seq", text.alias("line"), marker.alias("marker"))
    marked = marked.where(F.col("marker").isNotNull() | wanted)
    dealt = marked.repartition(SORTS_PER_SPLIT * split_count(lines), "file", "chunk")
    inside = W.partitionBy("file", "chunk").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    local = dealt.withColumn("open_here", F.last("marker", ignorenulls=True).over(inside))

    tails = marked.groupBy("file", "chunk").agg(
        F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("seq"))).alias("tail")
    )
    before = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(
        "file", "chunk", F.last("tail", ignorenulls=True).over(before).alias("open_before")
    )
    open_query = F.coalesce("open_here", "open_before")
    return (
        local.join(carried, ["file", "chunk"])
        .where(F.col("marker").isNull() & (open_query >= 0))
        .select("file", "chunk", "seq", "line", open_query.alias("query_no"))
    )


def returned_ids(lines: DataFrame) -> DataFrame:
    """Ids in output order: ``(file, query_no, rk, id)``."""
    order = W.partitionBy("file", "query_no").orderBy("chunk", "seq")
    wanted = F.col("line").rlike(ROW_ID_PATTERN)
    found = query_lines(lines, wanted).where(wanted)
    return found.select(
        "file",
        "query_no",
        F.row_number().over(order).alias("rk"),
        F.col("line").cast("long").alias("id"),
    )


def statement_times(lines: DataFrame) -> DataFrame:
    """Last reported time of every query: ``(file, query_no, elapsed_ms)``."""
    ms = F.regexp_extract("line", TIME_PATTERN, 1)
    found = query_lines(lines, F.length(ms) > 0).withColumn("ms", ms).where(F.length("ms") > 0)
    return found.groupBy("file", "query_no").agg(
        F.max_by(F.col("ms").cast("double"), F.struct("chunk", "seq")).alias("elapsed_ms")
    )


def begun_queries(lines: DataFrame) -> DataFrame:
    """Queries whose begin marker occurs: ``(file, query_no)``."""
    number = F.regexp_extract(strip("line"), QUERY_BEGIN_PATTERN, 1)
    return (
        lines.select("file", number.alias("number"))
        .where(F.length("number") > 0)
        .select("file", F.col("number").cast("long").alias("query_no"))
        .distinct()
    )


def queries_without_time(lines: DataFrame, query_count: int | None = None) -> DataFrame:
    """Queries that reported no time: ``(file, query_no)``; empty means complete.

    Expected are ``0 .. query_count-1`` of every file (a benchmark's bounded query set), or
    without a count the queries that were begun.
    """
    if query_count is None:
        expected = begun_queries(lines)
    else:
        if query_count < 1:
            raise ValueError("query_count must be positive")
        numbers = F.explode(F.expr(f"sequence(0L, {query_count - 1}L)")).alias("query_no")
        expected = lines.select("file").distinct().select("file", numbers)
    return expected.join(statement_times(lines), ["file", "query_no"], "left_anti")
