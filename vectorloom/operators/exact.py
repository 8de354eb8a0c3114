"""Exact k-nearest-neighbour and radius search.

Base rows never move: each scan task scores its own rows against the query block and ships
only its local best. When the queries are too many to ship to every task, both sides are
packed and meet in the cells of a grid instead (:mod:`~vectorloom.operators.cells`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.operators import cells
from vectorloom.operators.cells import CANDIDATES, candidate_batch, kept_batches
from vectorloom.operators.kernel import BestPerQuery, dense_matrix, lean, pair_distances
from vectorloom.operators.kernel import rounding_slack
from vectorloom.operators.topk import check_k, top_per_query
from vectorloom.session import BROADCAST_LIMIT_BYTES, MIB, fetch_bounded, materialize, split_count

#: Memory one task may spend on running bests.
STATE_LIMIT_BYTES = 64 * MIB
#: Most scans of the base worth paying before the block join takes over.
MAX_SCANS = 4


@dataclass
class QueryBlock:
    """Query vectors small enough to be shipped to every task."""

    index: np.ndarray
    vectors: np.ndarray
    ceiling: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.index)

    def plain(self) -> tuple:
        """Content as arrays: broadcasts carry data only, never classes of this package.

        Vectors that are whole in single precision are shipped in it.
        """
        return self.index, lean(self.vectors), self.ceiling

    def part(self, chosen) -> "QueryBlock":
        ceiling = None if self.ceiling is None else self.ceiling[chosen]
        return QueryBlock(self.index[chosen], self.vectors[chosen], ceiling)


def fetch_queries(queries: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES):
    """Queries as a block, or ``None`` when they exceed ``limit_bytes``."""
    queries = queries.select("query_index", "qvec")
    head = queries.select(F.size("qvec").alias("dim")).head()
    if head is None:
        return QueryBlock(np.empty(0, dtype=np.int64), np.empty((0, 0)))
    table = fetch_bounded(queries, max(1, limit_bytes // (8 * head.dim)))
    if table is None:
        return None
    index = table.column("query_index").to_numpy()
    vectors = dense_matrix(table.column("qvec"), head.dim)
    order = np.argsort(index, kind="stable")
    return QueryBlock(index[order], vectors[order])


def columns_of(base: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    return base.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding"), *more
    )


def local_best(base: DataFrame, block: QueryBlock, k: int) -> DataFrame:
    """Per task, the ``k`` best rows of every query: ``(query_index, id, dist)``."""
    shipped = base.sparkSession.sparkContext.broadcast(block.plain())

    def score(batches):
        queries = QueryBlock(*shipped.value)
        best = BestPerQuery(queries.vectors, k, queries.ceiling)
        dim = queries.vectors.shape[1]
        for batch in batches:
            best.offer(batch.column(0).to_numpy(), dense_matrix(batch.column(1), dim))
        yield from kept_batches(queries.index, best)

    return base.mapInArrow(score, CANDIDATES)


def with_ceiling(block: QueryBlock, k: int, probe: DataFrame):
    """Give every query an upper bound of its k-th distance.

    The k-th nearest row of any subset is at least as far as the k-th nearest of the whole
    table, so tasks may drop farther rows without changing the result. ``probe`` names the
    subset (one bucket, an index sample).
    """
    kth = (
        top_per_query(local_best(probe, block, k), k)
        .where(F.col("rk") == k)
        .select("query_index", "dist")
        .toArrow()
    )
    ceiling = np.full(len(block), np.inf)
    slots = np.searchsorted(block.index, kth.column("query_index").to_numpy())
    ceiling[slots] = kth.column("dist").to_numpy()
    return QueryBlock(block.index, block.vectors, ceiling)


def check_path(path: str, other: str) -> None:
    if path not in ("auto", "scan", other):
        raise ValueError(f"unknown path {path!r}; use auto, scan or {other}")


def knn_batch(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "embedding",
    probe: DataFrame | None = None,
    path: str = "auto",
) -> DataFrame:
    """Exact top-``k`` per query: ``(query_index, rk, id, dist)``.

    ``path``: ``scan`` ships the queries to the base, ``grid`` lets both sides meet in cells, ``auto``
    scans while few scans with shipped queries do. The rows are the same.
    """
    check_k(k)
    check_path(path, "grid")
    rows = columns_of(base, id_col, vec_col)
    block = None if path == "grid" else fetch_queries(queries)
    per_scan = max(1, STATE_LIMIT_BYTES // (16 * k))
    if path == "scan" and block is None:
        raise ValueError("too many queries to ship; use the grid")
    if block is None or (path == "auto" and len(block) > per_scan * MAX_SCANS):
        return knn_blocks(base, queries, k, id_col, vec_col)
    if len(block) and probe is not None:
        block = with_ceiling(block, k, columns_of(probe, id_col, vec_col))
    found = None
    for start in range(0, max(1, len(block)), per_scan):
        part = local_best(rows, block.part(slice(start, start + per_scan)), k)
        found = part if found is None else found.unionByName(part)
    return top_per_query(found, k).select("query_index", "rk", "id", "dist")


def knn_single(
    base: DataFrame, query, k: int, id_col: str = "id", vec_col: str = "embedding"
) -> DataFrame:
    """Exact top-``k`` of one query vector: ``(id, dist)`` ordered by distance, then id."""
    check_k(k)
    query = np.asarray(query, dtype=np.float64)
    rows = columns_of(base, id_col, vec_col)
    block = QueryBlock(np.zeros(1, dtype=np.int64), query[None, :])
    found = local_best(rows, block, k).select("id", "dist")
    return found.orderBy("dist", "id").limit(k)


def radius_search(
    base: DataFrame,
    queries: DataFrame,
    radius: float,
    id_col: str = "id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Every base row within ``radius`` of a query: ``(query_index, id, dist)``."""
    rows = columns_of(base, id_col, vec_col)
    block = fetch_queries(queries)
    if block is None:
        return radius_blocks(base, queries, radius, id_col, vec_col)
    shipped = rows.sparkSession.sparkContext.broadcast((block.index, block.vectors))

    def score(batches):
        queries = QueryBlock(*shipped.value)
        dim = queries.vectors.shape[1]
        for batch in batches:
            yield from within_radius(
                queries, batch.column(0).to_numpy(), dense_matrix(batch.column(1), dim), radius
            )

    return rows.mapInArrow(score, CANDIDATES)


def within_radius(block: QueryBlock, ids, rows, radius):
    """Batches of the pairs of one block with distance at most ``radius``."""
    if not len(rows) or not len(block):
        return
    row_norms = (rows * rows).sum(axis=1)
    norms = (block.vectors * block.vectors).sum(axis=1)
    step = max(1, 1_000_000 // len(rows))
    for start in range(0, len(block), step):
        part = slice(start, start + step)
        queries = block.vectors[part]
        approx = norms[part][:, None] + row_norms[None, :] - 2.0 * (queries @ rows.T)
        slack = rounding_slack(norms[part], row_norms, rows.shape[1])
        q, r = np.nonzero(approx <= (radius * radius + slack + slack)[:, None])
        for at in range(0, len(q), 50_000):
            qs, rs = q[at : at + 50_000], r[at : at + 50_000]
            dist = pair_distances(queries[qs], rows[rs])
            keep = dist <= radius
            yield candidate_batch(block.index[part][qs[keep]], ids[rs[keep]], dist[keep])


# --- both sides large -------------------------------------------------------------------


@dataclass(frozen=True)
class GridPlan:
    """Sizes of a search of a whole table: one list, ``row_groups x query_groups`` cells."""

    row_groups: int
    query_groups: int
    pack: int

    @property
    def cells(self):
        number = F.col("row_group") * self.query_groups + F.col("query_group")
        return self.row_groups * self.query_groups, number.cast("int")


def plan_grid(rows: DataFrame, queries: DataFrame, state_bytes: int, pack: int, tasks: int | None) -> GridPlan:
    """Grid of ``rows(id, embedding)`` and ``queries(query_index, qvec)``; ``state_bytes`` a query keeps."""
    head = queries.select(F.size("qvec").alias("dim")).head()
    dim = head.dim if head else 1
    n, m = rows.count(), queries.count()
    if tasks is None:
        context = rows.sparkSession.sparkContext
        work = n * m * dim / cells.CELL_WORK
        tasks = max(context.defaultParallelism, split_count(rows), int(work) + 1)
    size = 8 * dim
    return GridPlan(*cells.grid_shape(n, size, m, size, size + state_bytes, tasks), pack)


def grid_sides(rows: DataFrame, queries: DataFrame, plan: GridPlan) -> tuple[DataFrame, DataFrame]:
    """Packs of both sides, one copy per cell they belong to; queries may carry a ``ceiling``."""
    nowhere = F.lit(0).cast("long")
    row_groups, query_groups = F.lit(plan.row_groups).cast("long"), F.lit(plan.query_groups).cast("long")
    left = rows.select(nowhere.alias("list_id"), nowhere.alias("part"), "id", "embedding")
    group = F.pmod(F.xxhash64("query_index"), query_groups).alias("part")
    limits = ["ceiling"] if "ceiling" in queries.columns else []
    right = queries.select(nowhere.alias("list_id"), group, "query_index", "qvec", *limits)
    return (
        cells.row_packs(
            cells.pack_groups(left, plan.pack, cells.layout_of(rows.schema["embedding"].dataType)), row_groups, query_groups
        ),
        cells.query_packs(
            cells.pack_groups(right, plan.pack, cells.layout_of(queries.schema["qvec"].dataType)), row_groups
        ),
    )


def knn_blocks(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "embedding",
    pack: int = 2048,
    blocks: int | None = None,
    first_round: int | None = None,
) -> DataFrame:
    """Exact top-``k`` when neither side fits a broadcast: ``(query_index, rk, id, dist)``.

    ``blocks`` is the least number of cells. Every row group would ship ``k`` rows a query; a first
    round over one row in ``first_round`` bounds the k-th distance of each query, and only rows within it
    are shipped then. By default it is run when there are many row groups; 0 leaves it out. The bound
    never drops a row of the result.
    """
    check_k(k)
    rows = columns_of(base, id_col, vec_col)
    queries = queries.select("query_index", "qvec")
    plan = plan_grid(rows, queries, 16 * k, pack, blocks)
    if first_round is None:
        first_round = round(plan.row_groups**0.5) if plan.row_groups >= 16 else 0
    if first_round:
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(first_round)) == 0)
        small = GridPlan(max(1, plan.row_groups // first_round), plan.query_groups, pack)
        kth = top_per_query(in_cells(part, queries, small, k), k).where(F.col("rk") == k)
        bounds = materialize(kth.select("query_index", F.col("dist").alias("bound")), "bounds")
        ceiling = F.coalesce("bound", F.lit(float("inf"))).alias("ceiling")
        queries = queries.join(bounds, "query_index", "left").select("query_index", "qvec", ceiling)
    return top_per_query(in_cells(rows, queries, plan, k), k).select("query_index", "rk", "id", "dist")


def in_cells(rows: DataFrame, queries: DataFrame, plan: GridPlan, k: int) -> DataFrame:
    """``k`` best rows per query and row group."""
    sides = grid_sides(rows, queries, plan)
    return cells.meet(*sides, lambda: cells.Nearest(k), CANDIDATES, plan.cells)


class Within:
    """Visitor: all pairs of the cell within a radius."""

    def __init__(self, radius: float):
        self.radius = radius

    def open(self, list_id: int, packs: list) -> None:
        index, vectors, _ = cells.joined_packs(packs)
        self.block = QueryBlock(index, vectors)

    def offer(self, ids: bytes, payload: bytes):
        numbers, rows = cells.unpack(ids, payload)
        yield from within_radius(self.block, numbers, rows.astype(np.float64), self.radius)

    def close(self):
        return ()


def radius_blocks(base, queries, radius, id_col="id", vec_col="embedding", pack=2048, blocks=None):
    """Radius search in cells; see :func:`knn_blocks`."""
    rows = columns_of(base, id_col, vec_col)
    queries = queries.select("query_index", "qvec")
    plan = plan_grid(rows, queries, 0, pack, blocks)
    return cells.meet(*grid_sides(rows, queries, plan), lambda: Within(radius), CANDIDATES, plan.cells)
