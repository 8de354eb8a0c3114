"""Exact top-k by inner product with a pivot table.

Components are first made integers, ``floor(64 * x)``. With one more coordinate,
``sqrt(M - |x|^2)`` for the largest squared norm ``M`` (0 for a query), the order by inner product
is the order by Euclidean distance, which pivots can bound: ``|d(q, p) - d(x, p)| <= d(q, x)`` for
every pivot ``p``. The distances of all rows to all pivots are computed once and written beside
the rows. A query takes the maximum of the bounds over the pivots, visits the candidates in
the order of that bound and stops at the first whose bound lies beyond its k-th best score. Ties
go on, so a tied row with a smaller id is never missed. The start value of the k-th score
comes from the sample the pivots are chosen from: the k-th best of a part is a lower bound.

Rows and queries are packed into blocks and meet in a grid: rows are dealt to ``R`` groups, queries
to ``C``, so rows are sent ``C`` times and queries ``R`` times, and a cell holds bounded numbers of
both. Each cell gives only its ``k`` best rows per query.

Parameters of fixed size: ``SAMPLE`` rows (by hash of the id) to choose ``PIVOTS`` pivots from, by
farthest-first traversal. They steer the order of the search, never its result.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without an
id, take no part; shorter vectors count as padded with zeros; rows that carry the query's id are
its own, whatever their vector; if an id that is a query stands on several rows, the smallest
vector is the query; other repeated rows are candidates each; fewer than ``k`` candidates give
fewer rows; an empty table gives none; further columns are ignored. Components of 2^31 or more
after scaling, or scores of 2^63 or more, raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.columns import col
from vectorloom.session import materialize

SCALE = 64
PIVOTS = 32
SAMPLE = 2048
#: Rows per block, and rows and queries per cell of the grid.
BLOCK_ROWS = 4096
CELL_ROWS = 65_536
CELL_QUERIES = 4096
#: Candidates evaluated between two looks at the bound, queries bounded at once.
STEP, QUERIES_AT_ONCE = 512, 64

BLOCKS = "n long, dim long, top_norm double, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def scaled(column: pa.ListArray, width: int) -> np.ndarray:
    """Integer vectors as float64 rows, padded to ``width``."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(SCALE * flat)
    if len(whole) and np.abs(whole).max() >= 1 << 31:
        raise ValueError("a component is too large for an integer inner product")
    if len(size) and (size == width).all():
        return whole.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(n) for n in size])] = whole
    return out


def pack(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of ``(id, vector)`` rows."""

    def work(batches):
        for batch in batches:
            vectors = scaled(batch.column(1), width)
            ids = batch.column(0).to_numpy()
            for at in range(0, len(ids), BLOCK_ROWS):
                part = vectors[at : at + BLOCK_ROWS]
                row = {
                    "n": len(part), "dim": width, "top_norm": float((part * part).sum(axis=1).max()),
                    "ids": ids[at : at + BLOCK_ROWS].astype("<i8").tobytes(),
                    "vectors": part.astype("<i4").tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    SCHEMA = pa.schema(
        [("n", pa.int64()), ("dim", pa.int64()), ("top_norm", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())]
    )
    return rows.mapInArrow(work, BLOCKS)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], "<i4").reshape(row["n"], row["dim"])
    return np.frombuffer(row["ids"], "<i8"), vectors.astype(np.float64)


def lifted(vectors: np.ndarray, top_norm: float) -> np.ndarray:
    """Rows with the coordinate that turns inner products into distances."""
    rest = np.maximum(top_norm - (vectors * vectors).sum(axis=1), 0.0)
    return np.hstack([vectors, np.sqrt(rest)[:, None]])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(square - 2.0 * (points @ pivots.T), 0.0))


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` points, each farthest from those chosen before (fewer if points coincide)."""
    chosen = [0]
    near = distances(points, points[:1])[:, 0]
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[chosen[-1] :][:1])[:, 0])
    return points[chosen]


def with_pivots(blocks: DataFrame, pivots: np.ndarray, top_norm: float) -> DataFrame:
    """Blocks with the distances of their rows to the pivots: the pivot table."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, vectors = unpack(row)
                row["table"] = distances(lifted(vectors, top_norm), pivots).astype("<f8").tobytes()
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema.append(pa.field("table", pa.binary())))

    return blocks.mapInArrow(work, f"{BLOCKS}, table binary")


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; float64 is exact below 2^53."""
    bound = np.abs(query).sum() * (np.abs(rows).max() if rows.size else 0)
    if bound < 1 << 53:
        return (rows @ query).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows]
    if any(abs(x) >= 1 << 63 for x in exact):
        raise OverflowError("an inner product needs more than 64 bits")
    return np.array(exact, np.int64)


def start_scores(vectors: np.ndarray, ids: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int):
    """A lower bound of each query's k-th best score, from the sample."""
    out = np.full(len(ids), np.iinfo(np.int64).min)
    for i, (query, own) in enumerate(zip(vectors, ids)):
        scores = products(sample[sample_ids != own], query)
        if len(scores) >= k:
            out[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
    return out


class Search:
    """The best rows of a block of queries, over the row blocks offered so far."""

    def __init__(self, ids, vectors, table, kth, k: int, top_norm: float):
        self.ids, self.vectors, self.table, self.kth, self.k = ids, vectors, table, kth, k
        norms = (vectors * vectors).sum(axis=1)
        self.most = norms + top_norm
        self.slack = 1e-9 * self.most + 0.5
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def offer(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray) -> None:
        columns = np.ascontiguousarray(table.T)
        for start in range(0, len(self.ids), QUERIES_AT_ONCE):
            part = slice(start, start + QUERIES_AT_ONCE)
            bound = np.zeros((len(self.ids[part]), len(ids)))
            for p, column in enumerate(columns):
                gap = self.table[part, p][:, None] - column[None, :]
                np.maximum(bound, np.abs(gap, out=gap), out=bound)
            # No row's score is above this; 2 * score = |q|^2 + M - distance^2.
            highest = (self.most[part, None] - bound * bound) / 2 + self.slack[part, None]
            for i, high in enumerate(highest, start):
                self._visit(i, high, ids, vectors)

    def _visit(self, i: int, high: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        open_rows = np.flatnonzero((high >= self.kth[i]) & (ids != self.ids[i]))
        open_rows = open_rows[np.argsort(-high[open_rows], kind="stable")]
        for at in range(0, len(open_rows), STEP):
            some = open_rows[at : at + STEP]
            if high[some[0]] < self.kth[i]:
                break
            scores = products(vectors[some], self.vectors[i])
            good = scores >= self.kth[i]
            old_scores, old_ids = self.best[i]
            scores, found = np.append(old_scores, scores[good]), np.append(old_ids, ids[some[good]])
            keep = np.lexsort((found, -scores))[: self.k]
            self.best[i] = scores[keep], found[keep]
            if len(keep) == self.k:
                self.kth[i] = max(self.kth[i], scores[keep[-1]])

    def rows(self) -> pa.RecordBatch:
        counts = [len(s) for s, _ in self.best]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.ids, counts)),
                pa.array(np.concatenate([np.empty(0, np.int64), *(i for _, i in self.best)])),
                pa.array(np.concatenate([np.empty(0, np.int64), *(s for s, _ in self.best)])),
            ],
            names=["query_id", "vec_id", "score"],
        )


def top_inner_products(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, the
    ``k`` other rows of the largest inner product, ties to the smaller id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    width = rows.agg(F.max(F.size("v")).alias("w")).head().w or 1
    blocks = materialize(pack(rows, width), "vector-blocks")
    size = blocks.agg(F.sum("n").alias("n"), F.max("top_norm").alias("m")).head()
    n, top_norm = size.n or 0, size.m or 0.0
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # A sample of fixed size, the same in every run.
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toArrow().combine_chunks()
    sample_ids = sample.column("id").to_numpy()
    points = scaled(sample.column("v").combine_chunks(), width)
    pivots = farthest_first(lifted(points, top_norm), PIVOTS)

    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n_queries = max(1, -(-n // every))
    groups = max(spark.sparkContext.defaultParallelism, -(-n // CELL_ROWS))
    columns = max(1, -(-n_queries // CELL_QUERIES))
    table = materialize(with_pivots(blocks, pivots, top_norm), "pivot-table")
    in_rows = table.select(
        F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("r"),
        F.explode(F.expr(f"sequence(0L, {columns - 1}L)")).alias("c"),
        "n", "dim", "ids", "vectors", "table",
    )
    dealt = queries.repartition(columns, "id") if columns > 1 else queries
    in_columns = pack(dealt.select("id", "v"), width).select(
        F.pmod(F.xxhash64("ids"), F.lit(columns)).alias("c"),
        F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("r"),
        "n", "dim", "ids", "vectors",
    )

    def search(batch_rows: pa.Table, batch_queries: pa.Table) -> pa.Table:
        out = []
        blocks = [(*unpack(row), np.frombuffer(row["table"]).reshape(row["n"], -1)) for row in batch_rows.to_pylist()]
        for row in batch_queries.to_pylist():
            ids, queries = unpack(row)
            flat = np.hstack([queries, np.zeros((len(queries), 1))])
            kth = start_scores(queries, ids, sample_ids, points, k)
            found = Search(ids, queries, distances(flat, pivots), kth, k, top_norm)
            for block in blocks:
                found.offer(*block)
            out.append(found.rows())
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        return pa.Table.from_batches(out, schema)

    found = in_rows.groupBy("r", "c").cogroup(in_columns.groupBy("r", "c")).applyInArrow(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
