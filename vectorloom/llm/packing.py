"""Harmonic packing of documents into sequences of a fixed capacity.

A piece of length ``n`` belongs to class ``j = capacity // n``: ``j`` such pieces fill a
sequence. Each task fills the sequences of its classes with ``j`` pieces each, in the order
in which they come, without looking at any other task. Documents may be cut, so a rest that
would fill its class badly gives first a piece of exactly ``capacity // (j + 1)`` and is then
classed anew; what a full sequence of any class leaves open is at most ``waste`` of it.

The sequences a task cannot complete (less than one per class) would be mostly padding. Their
pieces go, with their ids, to a second step that lays them end to end and cuts at the
capacity; it works in groups of bounded size and leaves one short sequence in each.

Defined cases: a null or empty text is a document of its end id alone; rows with the same
doc_id are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.tokens import encoder
from vectorloom.session import materialize

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
#: Ids that one group of left-over pieces may hold.
GROUP_TOKENS = 2_000_000
#: Sequences of the second step are numbered from here on.
SECOND_STEP = 1 << 62

ARROW = {"long": pa.int64(), "binary": pa.binary()}


def piece_lengths(tokens: int, capacity: int, waste: float) -> list[int]:
    """Lengths into which a document is cut, in order."""
    lengths = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        fit = capacity // rest
        take = rest if fit * rest >= capacity * (1 - waste) else capacity // (fit + 1)
        lengths.append(take)
        rest -= take
    return lengths


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, ARROW[k]) for c, k in zip(columns, kinds)], names=list(names)
    )


def fill_classes(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, waste: float) -> DataFrame:
    """Pieces of full sequences, and the left-over ones (``sequence_id`` null) with their ids."""
    end = np.array([end_id], "<u4").tobytes()
    schema = f"{PIECES}, ids binary"

    def fill(batches):
        encode = encoder(vocabulary).encode
        number = TaskContext.get().partitionId() << 32
        open_bins: dict[int, list[tuple]] = defaultdict(list)
        out: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total, start = len(ids) // 4, 0
                for length in piece_lengths(total, capacity, waste):
                    piece = ids[4 * start : 4 * (start + length)]
                    bin_ = open_bins[capacity // length]
                    bin_.append((doc_id, start, length, zlib.crc32(piece), total, piece))
                    start += length
                    if len(bin_) == capacity // length:
                        offset = 0
                        for row in bin_:
                            out.append((*row[:5], number, offset, None))
                            offset += row[2]
                        bin_.clear()
                        number += 1
                if len(out) >= 10_000:
                    yield as_batch(out, schema)
                    out = []
        out += [(*row[:5], None, None, row[5]) for bin_ in open_bins.values() for row in bin_]
        yield as_batch(out, schema)

    return docs.mapInArrow(fill, schema)


def join_ends(left_over: DataFrame, capacity: int) -> DataFrame:
    """Left-over pieces laid end to end, group by group, and cut at the capacity."""
    tokens = left_over.agg(F.sum("length").alias("n")).head().n or 0
    groups = max(1, -(-tokens // GROUP_TOKENS))
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long")

    def lay(group: pa.Table) -> pa.Table:
        rows = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")]).to_pylist()
        number, offset = SECOND_STEP + (rows[0]["tail"] << 32), 0
        out = []
        for row in rows:
            used = 0
            while used < row["length"]:
                take = min(row["length"] - used, capacity - offset)
                crc = zlib.crc32(row["ids"][4 * used : 4 * (used + take)])
                out.append((row["doc_id"], row["start"] + used, take, crc, row["doc_tokens"], number, offset))
                used, offset = used + take, offset + take
                if offset == capacity:
                    number, offset = number + 1, 0
        return pa.Table.from_batches([as_batch(out, PIECES)])

    tails = left_over.select(key.alias("tail"), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
    return tails.groupBy("tail").applyInArrow(lay, PIECES)


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 1,
    capacity: int = 2048,
    waste: float = 1 / 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents and their places:
    ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(fill_classes(rows, vocabulary, end_id, capacity, waste), "pieces")
    full = pieces.where(F.col("sequence_id").isNotNull()).drop("ids")
    return full.unionByName(join_ends(pieces.where(F.col("sequence_id").isNull()), capacity))
