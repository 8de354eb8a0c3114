"""Token-id files of directly addressable codes.

Each id is cut into 8-bit chunks, lowest first. Level ``l`` holds the ``l``-th chunk of every
id that has one, one byte each, and a bitmap that says whether the id continues on the next
level. The place of a continuing id there is the number of set bits before it (its rank); a
directory with the rank at every 512th bit makes that a lookup plus one popcount. So any
token, or any range of tokens, is read without decoding what precedes it.

File format (little-endian). A file is a row of segments of ``SEGMENT`` tokens (the last may
be shorter), then the document table, then a trailer:

    segment   uint32 levels, uint32 0, uint64 count per level, then per level
              chunk bytes, bitmap (whole 512-bit blocks), uint32 ranks (one per block)
    documents int64 doc_id, uint8 doc_id-is-null, uint64 first token (one more entry: the end)
    segments  uint64 file offset of each segment
    trailer   uint64 documents, uint64 segments, uint64 offset of the document table, 8 bytes magic

:func:`write_tokens` writes one file per range of doc_id. Files get a name of their own in each
attempt of a task, and only the names in the manifest, which Spark's committer writes, count:
a repeated or lost task leaves a stray file but never a wrong result.

Defined cases: a null text is empty; every document gets the end id; rows are ordered by
doc_id (null first), rows of one doc_id by text; an empty table gives no rows; columns other
than the named ones are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.llm.tokens import encoder
from vectorloom.session import materialize, new_workdir, split_count

# Fixed values of the format.
MAGIC = b"VLDAC\x00\x01\n"
SEGMENT = 1 << 20
BLOCK_BITS = 512

TRAILER = "<QQQ8s"


def file_system(path: str):
    """(file system, path) of a URI or of an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


# --- one segment ----------------------------------------------------------------------------


def encode_segment(ids: np.ndarray) -> bytes:
    levels = []
    while True:
        more = ids > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK_BITS // 8)))
        ones = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK_BITS // 64).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)])[:-1].astype("<u4")
        levels.append((len(ids), (ids & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        ids = ids[more] >> 8
    head = struct.pack("<II", len(levels), 0) + b"".join(struct.pack("<Q", x[0]) for x in levels)
    return head + b"".join(part for level in levels for part in level[1:])


class Segment:
    """Random access to one segment through ``read(offset, size)``."""

    def __init__(self, read, offset: int):
        self.read = read
        count = struct.unpack("<II", read(offset, 8))[0]
        self.counts = struct.unpack(f"<{count}Q", read(offset + 8, 8 * count))
        self.levels, at = [], offset + 8 + 8 * count
        for n in self.counts:
            blocks = -(-n // BLOCK_BITS)
            bits, ranks = at + n, at + n + blocks * (BLOCK_BITS // 8)
            self.levels.append((at, bits, ranks))
            at = ranks + 4 * blocks

    def rank(self, level: int, position: int) -> int:
        """Set bits before ``position``; reads one directory entry and at most one block."""
        _, bits, ranks = self.levels[level]
        block = position // BLOCK_BITS
        base = struct.unpack("<I", self.read(ranks + 4 * block, 4))[0]
        within = position % BLOCK_BITS
        head = int.from_bytes(self.read(bits + block * (BLOCK_BITS // 8), -(-within // 8)), "little")
        return base + (head & ((1 << within) - 1)).bit_count()

    def token(self, position: int) -> int:
        """One id: a byte and a bit per level, and a rank where it continues."""
        value, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= self.read(chunks + position, 1)[0] << shift
            if not self.read(bits + position // 8, 1)[0] >> (position % 8) & 1:
                break
            position, shift = self.rank(level, position), shift + 8
        return value

    def tokens(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids of a range; only the bytes of that range are read."""
        chunks, bits, _ = self.levels[level]
        values = np.frombuffer(self.read(chunks + start, stop - start), np.uint8).astype("<u4")
        first = start // 8
        flags = np.frombuffer(self.read(bits + first, -(-stop // 8) - first), np.uint8)
        more = np.unpackbits(flags, bitorder="little")[start - 8 * first :][: stop - start].view(bool)
        going_on = int(more.sum())
        if going_on:
            at = self.rank(level, start)
            values[more] |= self.tokens(at, at + going_on, level + 1) << 8
        return values


# --- files ----------------------------------------------------------------------------------


class TokenFileWriter:
    """Streams documents into one file; memory is one segment and the document table."""

    def __init__(self, path: str):
        system, path = file_system(path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.open: list[np.ndarray] = []
        self.open_tokens = self.tokens = 0
        self.doc_ids: list[int | None] = []
        self.starts: list[int] = []
        self.segments: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.tokens)
        self.tokens += len(ids)
        self.open.append(ids)
        self.open_tokens += len(ids)
        if self.open_tokens >= SEGMENT:
            waiting = np.concatenate(self.open)
            whole = len(waiting) // SEGMENT * SEGMENT
            for at in range(0, whole, SEGMENT):
                self._write_segment(waiting[at : at + SEGMENT])
            self.open, self.open_tokens = [waiting[whole:]], len(waiting) - whole

    def _write_segment(self, ids: np.ndarray) -> None:
        self.segments.append(self.stream.tell())
        self.stream.write(encode_segment(ids))

    def close(self) -> None:
        if self.open_tokens:
            self._write_segment(np.concatenate(self.open))
        table = self.stream.tell()
        self.stream.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.stream.write(np.array([d is None for d in self.doc_ids], np.uint8).tobytes())
        self.stream.write(np.array([*self.starts, self.tokens], "<u8").tobytes())
        self.stream.write(np.array(self.segments, "<u8").tobytes())
        self.stream.write(struct.pack(TRAILER, len(self.doc_ids), len(self.segments), table, MAGIC))
        self.stream.close()


class TokenFile:
    """Reader: ``token(i)``, ``tokens(i, j)`` and ``document(k)`` by direct addressing."""

    def __init__(self, path: str):
        system, path = file_system(path)
        self.file = system.open_input_file(path)
        self.read = lambda offset, size: self.file.read_at(size, offset)
        size = self.file.size()
        trailer = struct.calcsize(TRAILER)
        documents, segments, table, magic = struct.unpack(TRAILER, self.read(size - trailer, trailer))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        at = table + 9 * documents
        nulls = self.read(table + 8 * documents, documents)
        ids = np.frombuffer(self.read(table, 8 * documents), "<i8").tolist()
        self.doc_ids = [None if null else i for i, null in zip(ids, nulls)]
        self.starts = np.frombuffer(self.read(at, 8 * documents + 8), "<u8").tolist()
        offsets = np.frombuffer(self.read(at + 8 * documents + 8, 8 * segments), "<u8").tolist()
        self.segments = [Segment(self.read, offset) for offset in offsets]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def token(self, position: int) -> int:
        return self.segments[position // SEGMENT].token(position % SEGMENT)

    def pieces(self, start: int, stop: int):
        """The ids of a range, one array per segment it touches."""
        while start < stop:
            segment, at = divmod(start, SEGMENT)
            end = min(stop - segment * SEGMENT, SEGMENT)
            yield self.segments[segment].tokens(at, end)
            start = segment * SEGMENT + end

    def tokens(self, start: int, stop: int) -> np.ndarray:
        return np.concatenate([np.empty(0, "<u4"), *self.pieces(start, stop)])

    def document(self, k: int) -> np.ndarray:
        return self.tokens(self.starts[k], self.starts[k + 1])

    def close(self) -> None:
        self.file.close()


# --- tables ---------------------------------------------------------------------------------

MANIFEST = "part int, file string, documents long, tokens long"


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    files: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode ``docs`` into token files; returns their manifest, also kept beside them.

    ``(part, file, documents, tokens, first_token)``; ``part`` numbers the files in ascending
    order of doc_id, ``first_token`` counts the tokens of all files before.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    folder = new_workdir(docs.sparkSession, "tokens")
    end = np.array([end_id], "<u4")

    def write(batches):
        encode = encoder(vocabulary).encode
        path = f"{folder}/files/{uuid.uuid4().hex}.dac"
        writer = TokenFileWriter(path)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(encode(text.as_py()), "<u4")
                writer.add(doc_id, np.concatenate([ids, end]))
        writer.close()
        if writer.doc_ids:
            row = [TaskContext.get().partitionId()], [path], [len(writer.doc_ids)], [writer.tokens]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["part", "file", "documents", "tokens"],
            )

    ordered = rows.repartitionByRange(files or max(1, split_count(rows)), "doc_id")
    written = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST)
    # One row per file, so this running sum is small however many documents there are.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(written, "token-manifest").withColumn(
        "first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))
    )


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of token files: place, length and checksum of the ids read back.

    ``(doc_id, start, n_tokens, ids_crc32, file)``; ``start`` counts over all files.
    """

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = TokenFile(path)
                for at in range(0, len(tokens), 10_000):
                    some = range(at, min(at + 10_000, len(tokens)))
                    yield checked(tokens, first, path, some)
                tokens.close()

    files = manifest.select("file", "first_token")
    spread = files.repartition(max(1, spark.sparkContext.defaultParallelism), "file")
    return spread.mapInArrow(read, DOCUMENTS)


def checked(tokens: TokenFile, first: int, path: str, some: range) -> pa.RecordBatch:
    """One row per document of ``some``; neighbours are read together, segment by segment."""
    starts = tokens.starts
    sums = [0] * len(some)
    k, at = 0, starts[some.start]
    for ids in tokens.pieces(at, starts[some.stop]):
        raw, used = ids.tobytes(), 0
        while used < len(ids):
            end = starts[some.start + k + 1]
            if at == end:
                k += 1
                continue
            take = min(end - at, len(ids) - used)
            sums[k] = zlib.crc32(raw[4 * used : 4 * (used + take)], sums[k])
            used, at = used + take, at + take
    lengths = [starts[i + 1] - starts[i] for i in some]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([tokens.doc_ids[i] for i in some], pa.int64()),
            pa.array([first + starts[i] for i in some], pa.int64()),
            pa.array(lengths, pa.int64()),
            pa.array(sums, pa.int64()),
            pa.array([path] * len(some), pa.string()),
        ],
        names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
    )
