"""Base rows and queries that meet in cells of a grid.

Both sides travel as packs: one row holds the ids and vectors of many. The base rows of a list
(a whole table is one list) are dealt over row groups, its queries over query groups, and every
row group meets every query group of the list in a cell. A base pack is copied once per query group,
a query pack once per row group, and :func:`grid_shape` picks both numbers from the sizes of both sides.

Inside a cell query packs sort before base packs. A task loads the queries of a cell, which are
bounded by construction (:data:`QUERY_CELL_BYTES`), and lets the base packs pass by, so a row group may be of
any size and no row ever holds the vectors of both sides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.operators.kernel import BestPerQuery, dense_matrix
from vectorloom.session import MIB

CANDIDATES = "query_index long, id long, dist double"

#: Memory for the queries of one cell, running bests included.
QUERY_CELL_BYTES = 64 * MIB
#: Products of coordinates one cell should compute at most.
CELL_WORK = 1e12

#: Rows of one batch a task gives back.
BATCH_ROWS = 200_000

PACKS = "list_id long, part long, pack long, ids binary, payload binary, limits binary"
PACK_SCHEMA = pa.schema(
    [
        ("list_id", pa.int64()), ("part", pa.int64()), ("pack", pa.int64()), ("ids", pa.binary()),
        ("payload", pa.binary()), ("limits", pa.binary()),
    ]
)
KEYS = ["list_id", "row_group", "query_group"]
#: Length of the list number before a listed pack.
LIST_BYTES = 8


def candidate_batch(index, ids, dist) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(index, pa.int64()), pa.array(ids, pa.int64()), pa.array(dist, pa.float64())],
        names=["query_index", "id", "dist"],
    )


def kept_batches(index: np.ndarray, best: BestPerQuery):
    """Candidates of everything kept, a bounded number of queries at a time."""
    step = max(1, BATCH_ROWS // best.k)
    for start in range(0, len(index), step):
        position, ids, dist = best.rows(slice(start, start + step))
        yield candidate_batch(index[start : start + step][position], ids, dist)


def grid_shape(rows: int, row_bytes: int, queries: int, query_bytes: int, state_bytes: int, tasks: int) -> tuple[int, int]:
    """``(row groups, query groups)`` that copy the fewest bytes for at least ``tasks`` cells.

    With R x C cells the base is copied C times and the queries R times. ``state_bytes`` is what
    a task keeps per query; it sets the least number of query groups.
    """
    least = max(1, math.ceil(queries * state_bytes / QUERY_CELL_BYTES))
    even = math.sqrt(tasks * max(1, queries * query_bytes) / max(1, rows * row_bytes))
    query_groups = max(least, min(max(1, round(even)), tasks))
    return max(1, math.ceil(tasks / query_groups)), query_groups


def layout_of(vector_type) -> str:
    """NumPy type in which the elements of a vector column travel; they keep their own precision."""
    return "<f4" if vector_type.elementType.simpleString() == "float" else "<f8"


def pack_groups(rows: DataFrame, rows_per_pack: int, layout: str, listed: bool = False) -> DataFrame:
    """Packs of rows with the same list and part.

    ``rows`` has ``(list_id, part, id, values)`` in that order, and perhaps a number per row after
    them. ``layout`` is the NumPy type of the values; a pack starts with its item size, after
    the number of its list if it is ``listed``.
    """
    limited = len(rows.columns) == 5

    def pack(batches):
        for batch in batches:
            lists, parts, ids = (batch.column(c).to_numpy() for c in range(3))
            values = dense_matrix(batch.column(3)).astype(layout)
            limits = batch.column(4).to_numpy() if limited else None
            order = np.lexsort((parts, lists))
            cuts = np.flatnonzero((np.diff(lists[order]) != 0) | (np.diff(parts[order]) != 0)) + 1
            out = []
            for group in np.split(order, cuts):
                for start in range(0, len(group), rows_per_pack):
                    at = group[start : start + rows_per_pack]
                    name = int(lists[at[0]]).to_bytes(LIST_BYTES, "little") if listed else b""
                    out.append(
                        {
                            "list_id": int(lists[at[0]]), "part": int(parts[at[0]]), "pack": int(ids[at[0]]),
                            "ids": ids[at].astype("<i8").tobytes(),
                            "payload": name + layout[-1].encode() + values[at].tobytes(),
                            "limits": limits[at].astype("<f8").tobytes() if limited else None,
                        }
                    )
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=PACK_SCHEMA)

    return rows.mapInArrow(pack, PACKS)


def unpack(ids: bytes, payload: bytes, prefix: str = "<f"):
    numbers = np.frombuffer(ids, dtype="<i8")
    kind = f"{prefix}{payload[:1].decode()}"
    return numbers, np.frombuffer(payload, dtype=kind, offset=1).reshape(len(numbers), -1)


def row_packs(packs: DataFrame, row_groups: Column, query_groups: Column) -> DataFrame:
    """Base packs, each in one row group and once per query group."""
    return packs.select(
        "list_id",
        F.pmod(F.xxhash64("list_id", "pack"), row_groups).alias("row_group"),
        F.explode(F.sequence(F.lit(0).cast("long"), query_groups - 1)).alias("query_group"),
        F.lit(1).alias("side"), "pack", "ids", "payload", "limits",
    )


def listed_packs(packs: DataFrame, query_groups: int, side: int) -> DataFrame:
    """Listed base packs of all lists as one table, in order of their lists, once per query group."""
    nowhere = F.lit(0).cast("long")
    return packs.select(
        nowhere.alias("list_id"), nowhere.alias("row_group"),
        F.explode(F.sequence(nowhere, F.lit(query_groups - 1).cast("long"))).alias("query_group"),
        F.lit(side).alias("side"), F.col("list_id").alias("pack"), "ids", "payload", "limits",
    )


def query_packs(packs: DataFrame, row_groups: Column) -> DataFrame:
    """Query packs, each once per row group; their part is the query group."""
    return packs.select(
        "list_id",
        F.explode(F.sequence(F.lit(0).cast("long"), row_groups - 1)).alias("row_group"),
        F.col("part").alias("query_group"),
        F.lit(0).alias("side"), "pack", "ids", "payload", "limits",
    )


def meet(rows: DataFrame, queries: DataFrame, visitor, schema: str, cells: tuple[int, Column] | None = None) -> DataFrame:
    """Run ``visitor`` over every cell.

    ``visitor()`` gives an object with ``open(list_id, packs)``, ``offer(ids, payload)`` and
    ``close()``; the last two give Arrow batches of ``schema``. Rows of side 2 come after those of side 1 and
    go to ``offer_last``. ``cells`` numbers the cells when their count is known, so that each becomes one
    partition; else they are hashed.
    """
    both = queries.unionByName(rows)
    dealt = both.repartition(*KEYS) if cells is None else both.repartitionById(*cells)
    in_order = dealt.sortWithinPartitions(*KEYS, "side", "pack").select(*KEYS, "side", "ids", "payload", "limits")

    def walk(batches):
        cell, asked, seen = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            sides = batch.column(3).to_pylist()
            for row in range(batch.num_rows):
                if keys[row] != cell:
                    if seen is not None:
                        yield from seen.close()
                    cell, asked, seen = keys[row], [], None
                ids, payload = batch.column(4)[row].as_py(), batch.column(5)[row].as_py()
                if sides[row] == 0:
                    asked.append((ids, payload, batch.column(6)[row].as_py()))
                elif asked or seen is not None:
                    if seen is None:
                        seen = visitor()
                        seen.open(cell[0], asked)
                        asked = []  # the visitor holds what it needs of them
                    yield from (seen.offer if sides[row] == 1 else seen.offer_last)(ids, payload)
        if seen is not None:
            yield from seen.close()

    return in_order.mapInArrow(walk, schema)


def joined_packs(packs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors as doubles and limits of the query packs of a cell."""
    parts = [unpack(ids, payload) for ids, payload, _ in packs]
    limits = [
        np.full(len(ids), np.inf) if limit is None else np.frombuffer(limit, dtype="<f8")
        for (ids, _), (_, _, limit) in zip(parts, packs)
    ]
    index = np.concatenate([ids for ids, _ in parts])
    vectors = np.empty((len(index), parts[0][1].shape[1]))
    at = 0
    for _, some in parts:
        vectors[at : at + len(some)] = some
        at += len(some)
    return index, vectors, np.concatenate(limits)


class Nearest:
    """Visitor: the ``k`` nearest rows of the cell for each of its queries."""

    def __init__(self, k: int):
        self.k = k

    def open(self, list_id: int, packs: list) -> None:
        self.index, vectors, limits = joined_packs(packs)
        self.best = BestPerQuery(vectors, self.k, limits)

    def offer(self, ids: bytes, payload: bytes):
        numbers, rows = unpack(ids, payload)
        self.best.offer(numbers, rows.astype(np.float64))
        return ()

    def close(self):
        yield from kept_batches(self.index, self.best)
