"""Fixed-length vector record files: ``fvecs`` (float32) and ``ivecs`` (int32).

A record is a little-endian int32 width followed by that many 4-byte values. Because the
length is fixed, any byte range that starts on a record can be read alone and ids follow from
the position in the file: reading needs neither a counting job nor a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from vectorloom.operators.kernel import dense_matrix

DEFAULT_SPLIT_BYTES = 128 * 1024 * 1024
BATCH_ROWS = 8192


def record_bytes(width: int) -> int:
    if width < 1:
        raise ValueError(f"record width must be positive, got {width}")
    return 4 + 4 * width


@dataclass
class RecordRange(InputPartition):
    """Whole records ``first .. first+count-1`` of one file; ``ordinal`` counts across files."""

    path: str
    first: int
    count: int
    ordinal: int


@dataclass
class WrittenPart(WriterCommitMessage):
    path: str
    records: int


def open_filesystem(path: str):
    """File system and plain path of a location (bare path or URI)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """Record files under ``path`` with their sizes, in name order."""
    from pyarrow import fs

    system, root = open_filesystem(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    files = [
        (f.path, f.size)
        for f in found
        if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))
    ]
    return sorted(files)


class RecordReader(DataSourceReader):
    value_type: str
    arrow_type: pa.DataType
    names: tuple[str, str]

    def __init__(self, options):
        self.path = options["path"]
        self.width = int(options["width"])
        self.id_base = int(options.get("idbase", 0))
        self.split_bytes = int(options.get("splitbytes", DEFAULT_SPLIT_BYTES))
        self.low, self.high, self.chosen = None, None, None

    def pushFilters(self, filters):
        """Turn comparisons on the id into a range of ordinals; Spark still re-checks them."""
        for item in filters:
            if getattr(item, "attribute", None) == (self.names[0],):
                value = getattr(item, "value", None)
                if isinstance(item, EqualTo):
                    self._narrow(value, value)
                elif isinstance(item, GreaterThanOrEqual):
                    self._narrow(value, None)
                elif isinstance(item, GreaterThan):
                    self._narrow(value + 1, None)
                elif isinstance(item, LessThanOrEqual):
                    self._narrow(None, value)
                elif isinstance(item, LessThan):
                    self._narrow(None, value - 1)
                elif isinstance(item, In):
                    wanted = {int(v) - self.id_base for v in item.value}
                    self.chosen = wanted if self.chosen is None else self.chosen & wanted
            yield item

    def _narrow(self, low, high):
        if low is not None:
            low = int(low) - self.id_base
            self.low = low if self.low is None else max(self.low, low)
        if high is not None:
            high = int(high) - self.id_base
            self.high = high if self.high is None else min(self.high, high)

    def partitions(self):
        size = record_bytes(self.width)
        per_split = max(1, self.split_bytes // size)
        out, ordinal = [], 0
        for path, length in list_files(self.path):
            if length % size:
                raise ValueError(
                    f"{path} holds {length} bytes, not a multiple of the record length {size}"
                )
            records = length // size
            for first in range(0, records, per_split):
                part = RecordRange(path, first, min(per_split, records - first), ordinal + first)
                out.extend(self._pruned(part))
            ordinal += records
        return out or [RecordRange("", 0, 0, 0)]

    def _pruned(self, part: RecordRange):
        low = part.ordinal if self.low is None else max(part.ordinal, self.low)
        last = part.ordinal + part.count - 1
        high = last if self.high is None else min(last, self.high)
        if low > high:
            return
        if self.chosen is None:
            yield RecordRange(part.path, part.first + low - part.ordinal, high - low + 1, low)
            return
        inside = [c for c in self.chosen if low <= c <= high]
        if inside:
            low, high = min(inside), max(inside)
            yield RecordRange(part.path, part.first + low - part.ordinal, high - low + 1, low)

    def read(self, partition: RecordRange):
        if partition.count == 0:
            return
        size = record_bytes(self.width)
        layout = np.dtype([("width", "<i4"), ("values", self.value_type, (self.width,))])
        system, path = open_filesystem(partition.path)
        with system.open_input_file(path) as handle:
            handle.seek(partition.first * size)
            done = 0
            while done < partition.count:
                wanted = min(BATCH_ROWS, partition.count - done)
                raw = handle.read(wanted * size)
                if len(raw) != wanted * size:
                    raise EOFError(f"{partition.path} ends inside a record")
                records = np.frombuffer(raw, dtype=layout)
                start = partition.ordinal + done
                wrong = np.flatnonzero(records["width"] != self.width)
                if wrong.size:
                    at = int(wrong[0])
                    raise ValueError(
                        f"record {start + at + self.id_base} of {partition.path} has width "
                        f"{int(records['width'][at])}, expected {self.width}"
                    )
                yield self.batch(np.arange(start, start + wanted), records["values"])
                done += wanted

    def batch(self, ordinals: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        count = len(ordinals)
        offsets = pa.array(np.arange(count + 1, dtype=np.int32) * self.width)
        flat = pa.array(np.ascontiguousarray(values).reshape(-1), type=self.arrow_type)
        return pa.RecordBatch.from_arrays(
            [pa.array(ordinals + self.id_base, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
            names=list(self.names),
        )


class FvecsReader(RecordReader):
    value_type, arrow_type, names = "<f4", pa.float32(), ("id", "embedding")


class IvecsReader(RecordReader):
    value_type, arrow_type, names = "<i4", pa.int32(), ("query_index", "neighbors")


class RecordWriter(DataSourceArrowWriter):
    """One file per task, named by task number, so name order is partition order."""

    def __init__(self, options, value_type: str):
        self.path, self.width = options["path"], int(options["width"])
        self.value_type = value_type

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = open_filesystem(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():06d}"
        attempt = f"{root}/.{name}-{context.taskAttemptId()}"
        layout = np.dtype([("width", "<i4"), ("values", self.value_type, (self.width,))])
        written = 0
        with system.open_output_stream(attempt) as handle:
            for batch in iterator:
                values = dense_matrix(batch.column(1), self.width)
                records = np.empty(len(values), dtype=layout)
                records["width"], records["values"] = self.width, values
                handle.write(records.tobytes())
                written += len(values)
        return WrittenPart(f"{attempt}\n{root}/{name}", written)

    def commit(self, messages):
        """Only committed attempts get a visible name."""
        system, _ = open_filesystem(self.path)
        for message in messages:
            if message is not None:
                attempt, final = message.path.split("\n")
                system.move(attempt, final)

    def abort(self, messages):
        system, _ = open_filesystem(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(message.path.split("\n")[0])


class FvecsSource(DataSource):
    reader_class, written_type = FvecsReader, "<f4"

    @classmethod
    def name(cls):
        return "fvecs"

    def schema(self):
        return "id long, embedding array<float>"

    def reader(self, schema):
        return self.reader_class(self.options)

    def writer(self, schema, overwrite):
        return RecordWriter(self.options, self.written_type)


class IvecsSource(FvecsSource):
    reader_class, written_type = IvecsReader, "<i4"

    @classmethod
    def name(cls):
        return "ivecs"

    def schema(self):
        return "query_index long, neighbors array<int>"


def register_sources(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)


def read_fvecs(
    spark: SparkSession, path: str, dim: int, id_base: int = 1, split_bytes: int | None = None
) -> DataFrame:
    """``(id, embedding)``; ids are ``id_base`` plus the record's position."""
    register_sources(spark)
    reader = spark.read.format("fvecs").option("width", dim).option("idbase", id_base)
    if split_bytes:
        reader = reader.option("splitbytes", split_bytes)
    return reader.load(path)


def read_ivecs(
    spark: SparkSession, path: str, gt_width: int, k: int | None = None, id_base: int = 0
) -> DataFrame:
    """``(query_index, neighbors)``: first ``k`` neighbours, shifted to table ids."""
    if k is not None and not 1 <= k <= gt_width:
        raise ValueError(f"k must lie in 1..{gt_width}, got {k}")
    register_sources(spark)
    raw = spark.read.format("ivecs").option("width", gt_width).load(path)
    kept = F.slice("neighbors", 1, k) if k is not None else F.col("neighbors")
    shifted = F.transform(kept, lambda x: x.cast("long") + F.lit(id_base))
    return raw.select("query_index", shifted.alias("neighbors"))


def read_fvecs_at(spark: SparkSession, path: str, ordinals: list[int], dim: int) -> DataFrame:
    """Vectors at the given ordinals as ``(position, ordinal, embedding)`` in request order."""
    total = record_count(spark, path, dim).agg(F.sum("records")).head()[0]
    outside = [o for o in ordinals if not 0 <= o < total]
    if outside:
        raise ValueError(f"{path} holds {total} records, no record {outside[0]}")
    wanted = spark.createDataFrame(list(enumerate(ordinals)), "position long, ordinal long")
    return read_fvecs_ordinals(path, wanted, dim).select("position", "ordinal", "embedding")


#: Unwanted bytes between two wanted records that are read rather than skipped.
READ_GAP_BYTES = 64 * 1024


def read_fvecs_ordinals(
    path: str, wanted: DataFrame, dim: int, column: str = "ordinal", split_bytes: int = DEFAULT_SPLIT_BYTES
) -> DataFrame:
    """``wanted`` with the ``embedding`` at each of its ordinals, for any number of them.

    The ordinals meet the byte ranges of the files at run time: distinct ones are dealt by range, so ranges
    without any are never opened, and a task reads only the records it was given, neighbours in one read. Rows
    may ask for the same ordinal as often as they like; a null asks for nothing and is dropped, one outside of
    the files is an error. Only the list of files travels to the tasks.
    """
    size = record_bytes(dim)
    starts, paths, total = [], [], 0
    for name, length in list_files(path):
        if length % size:
            raise ValueError(f"{name} holds {length} bytes, not a multiple of the record length {size}")
        starts.append(total)
        paths.append(name if "://" not in path else path.split("://")[0] + "://" + name)
        total += length // size
    split = F.floor(F.col("__ordinal") / max(1, split_bytes // size)).alias("split")
    distinct = wanted.select(F.col(column).cast("long").alias("__ordinal")).where("__ordinal is not null").distinct()
    dealt = distinct.select("__ordinal", split).repartition("split").sortWithinPartitions("__ordinal")
    shipped = wanted.sparkSession.sparkContext.broadcast((np.array(starts, dtype=np.int64), paths))

    def read(batches):
        first, names = shipped.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            bad = at[(at < 0) | (at >= total)]
            if len(bad):
                raise ValueError(f"{path} holds {total} records, no record {int(bad[0])}")
            file = np.searchsorted(first, at, side="right") - 1
            # Empty files share their start with the next one; the last of them holds the record.
            gap = (np.diff(at) - 1) * size > READ_GAP_BYTES
            long = np.diff(at // BATCH_ROWS) != 0
            for run in np.split(np.arange(len(at)), np.flatnonzero(gap | long | (np.diff(file) != 0)) + 1):
                if len(run):
                    yield from records_at(names[file[run[0]]], at[run], int(first[file[run[0]]]), dim)

    found = dealt.select("__ordinal").mapInArrow(read, "__ordinal long, embedding array<float>")
    return wanted.join(found, F.col(column).cast("long") == F.col("__ordinal")).drop("__ordinal")


def records_at(path: str, ordinals: np.ndarray, first: int, dim: int):
    """One read from the first to the last of ``ordinals``; the file starts at ordinal ``first``."""
    size = record_bytes(dim)
    system, plain = open_filesystem(path)
    count = int(ordinals[-1] - ordinals[0]) + 1
    with system.open_input_file(plain) as handle:
        handle.seek(int(ordinals[0] - first) * size)
        raw = handle.read(count * size)
    if len(raw) != count * size:
        raise EOFError(f"{path} ends inside a record")
    records = np.frombuffer(raw, dtype=np.dtype([("width", "<i4"), ("values", "<f4", (dim,))]))[ordinals - ordinals[0]]
    wrong = np.flatnonzero(records["width"] != dim)
    if wrong.size:
        at = int(wrong[0])
        raise ValueError(f"record {int(ordinals[at])} of {path} has width {int(records['width'][at])}, expected {dim}")
    offsets = pa.array(np.arange(len(records) + 1, dtype=np.int32) * dim)
    flat = pa.array(np.ascontiguousarray(records["values"]).reshape(-1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(ordinals), pa.ListArray.from_arrays(offsets, flat)], names=["__ordinal", "embedding"]
    )


def write_records(df: DataFrame, path: str, width: int, kind: str = "fvecs") -> None:
    """Write ``(key, values)`` rows as record files in row order of the partitions."""
    register_sources(df.sparkSession)
    df.write.format(kind).option("width", width).mode("append").save(path)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` as ``(path, length)``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )


def record_count(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``(path, length, records)`` per file; a partial record is an error."""
    size = record_bytes(width)
    broken = F.raise_error(
        F.concat(F.col("path"), F.lit(f" is not a multiple of {size} bytes: "), F.col("length"))
    ).cast("long")
    whole = F.when(F.col("length") % size == 0, F.expr(f"length div {size}")).otherwise(broken)
    return file_listing(spark, path).select("path", "length", whole.alias("records"))


def header_violations(
    spark: SparkSession, path: str, width: int, split_bytes: int = DEFAULT_SPLIT_BYTES
) -> DataFrame:
    """Records whose header differs from ``width``: ``(path, ordinal, header)``.

    Every file is cut into record ranges first, so a single huge file is many tasks.
    """
    size = record_bytes(width)
    per_split = max(1, split_bytes // size)
    last = F.greatest(F.expr(f"length div {size}") - 1, F.lit(0))
    ranges = file_listing(spark, path).select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(per_split).cast("long"))).alias("first")
    )
    tasks = spark.sparkContext.defaultParallelism

    def headers(batches):
        for batch in batches:
            for path, length, first in zip(*(c.to_pylist() for c in batch.columns)):
                count = min(per_split, length // size - first)
                yield from scan_headers(path, first, count, width)

    schema = "path string, ordinal long, header int"
    return ranges.repartition(tasks, "path", "first").mapInArrow(headers, schema)


def scan_headers(path: str, start: int, total: int, width: int):
    size = record_bytes(width)
    system, plain = open_filesystem(path)
    with system.open_input_file(plain) as handle:
        for first in range(start, start + total, BATCH_ROWS):
            count = min(BATCH_ROWS, start + total - first)
            handle.seek(first * size)
            words = np.frombuffer(handle.read(count * size), dtype="<i4").reshape(count, -1)[:, 0]
            wrong = np.flatnonzero(words != width)
            if wrong.size:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(wrong)),
                        pa.array(wrong + first, pa.int64()),
                        pa.array(words[wrong], pa.int32()),
                    ],
                    names=["path", "ordinal", "header"],
                )
