"""NumPy block helpers that run inside Spark tasks.

Spark decides which rows meet which queries; these helpers only score one Arrow batch
and keep the best few per query.
"""

from __future__ import annotations

import numpy as np

#: Elements of one scratch matrix (doubles); bounds the memory of a scoring step.
SCRATCH = 4_000_000
#: Elements of the matrices of a search step; small enough for the caches.
PAIR_SCRATCH = 1_000_000
#: Kept rows per query from which they are not held in order.
WIDE_POOL = 32
#: Rows scored at a time at least.
ROW_STEP = 2048
#: Squared length up to which products are taken in single precision.
SINGLE_NORM = 1e30

NO_ID = np.iinfo(np.int64).max


def dense_matrix(column, dim: int | None = None) -> np.ndarray:
    """``rows x dim`` float64 matrix of an Arrow list column; ragged or null input fails."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    rows = len(column)
    if column.null_count:
        raise ValueError("vector column contains null vectors")
    if rows == 0:
        return np.empty((0, dim or 0))
    lengths = np.diff(np.asarray(column.offsets))
    width = int(lengths[0]) if dim is None else dim
    bad = np.flatnonzero(lengths != width)
    if bad.size:
        raise ValueError(
            f"vector {int(bad[0])} of the batch has {int(lengths[bad[0]])} dimensions, expected {width}"
        )
    values = column.flatten()
    if values.null_count:
        raise ValueError("vector column contains null elements")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, width)


def pair_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise L2 distance, double accumulation."""
    diff = left - right
    return np.sqrt((diff * diff).sum(axis=1))


def squared_to_each(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared L2 of every row to every center, term by term (no norm expansion)."""
    out = np.empty((len(rows), len(centers)))
    step = max(1, SCRATCH // max(1, centers.size))
    for start in range(0, len(rows), step):
        diff = rows[start : start + step, None, :] - centers[None, :, :]
        out[start : start + step] = (diff * diff).sum(axis=2)
    return out


def nearest_center(rows: np.ndarray, centers: np.ndarray, decimals: int = 9) -> np.ndarray:
    """Index of the nearest center per row; equal rounded distances go to the lowest index.

    Identical centers are compared once: where many rows are copies, so are many seeds.
    """
    _, first = np.unique(centers, axis=0, return_index=True)
    first.sort()
    distinct = centers[first]
    norms = (distinct * distinct).sum(axis=1)
    out = np.empty(len(rows), dtype=np.int64)
    step = max(1, SCRATCH // 16 // max(1, len(distinct)))
    for start in range(0, len(rows), step):
        block = rows[start : start + step]
        # The row's own norm is the same for every center, so it is left out of the ranking.
        score = block @ (-2.0 * distinct.T)
        score += norms
        best = score.argmin(axis=1)
        lowest = score[np.arange(len(block)), best]
        slack = 2.0 * 10.0**-decimals + rounding_slack((block * block).sum(axis=1), norms, rows.shape[1])
        close = score <= (lowest + slack)[:, None]
        unsure = np.flatnonzero(np.count_nonzero(close, axis=1) > 1)
        if len(unsure):
            rivals = np.flatnonzero(close[unsure].any(axis=0))
            exact = np.round(squared_to_each(block[unsure], distinct[rivals]), decimals)
            best[unsure] = rivals[exact.argmin(axis=1)]
        out[start : start + step] = first[best]
    return out


def sums_by(keys: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Vector sums and row counts per key ``0 .. count-1``."""
    sums, counts = np.zeros((count, rows.shape[1])), np.bincount(keys, minlength=count)
    used = np.flatnonzero(counts)
    if len(used):
        starts = np.concatenate([[0], np.cumsum(counts[used])[:-1]])
        sums[used] = np.add.reduceat(rows[np.argsort(keys, kind="stable")], starts, axis=0)
    return sums, counts


def spare_copies(ids: np.ndarray, rows: np.ndarray, norms: np.ndarray, k: int):
    """Positions that can matter: of identical rows only the ``k`` lowest ids (``None`` = all).

    Copies are equally far from every query, so a higher id can never displace a lower one.
    """
    alike = np.count_nonzero(np.diff(np.sort(norms)) == 0)
    if alike < max(k, len(ids) // 8):
        return None
    # A second projection keeps apart different rows that merely have the same length.
    weighted = (rows * np.cos(np.arange(rows.shape[1]))).sum(axis=1)
    order = np.lexsort((ids, weighted, norms))
    alike = (np.diff(norms[order]) == 0) & (np.diff(weighted[order]) == 0)
    at = np.flatnonzero(alike)
    same = np.zeros(len(ids), dtype=bool)
    same[at + 1] = (rows[order[at]] == rows[order[at + 1]]).all(axis=1)
    position = np.arange(len(ids))
    run_start = np.maximum.accumulate(np.where(same, 0, position))
    return order[position - run_start < k]


def rounding_slack(own_norms: np.ndarray, norms: np.ndarray, dim: int) -> np.ndarray:
    """Upper bound of the error the norm expansion can add to a squared distance."""
    largest = float(norms.max()) if len(norms) else 0.0
    return 8.0 * (dim + 4) * np.finfo(np.float64).eps * (own_norms + largest)


class RowBlock:
    """Rows ready for :func:`near_pairs`: transposed once, their norms as a last coordinate.

    Products are taken in single precision while no square can overflow it.
    """

    def __init__(self, rows: np.ndarray, norms: np.ndarray):
        self.rows, self.norms = rows, norms
        self.largest = float(norms.max())
        self.kind = np.float32 if self.largest < SINGLE_NORM else np.float64
        self.operand = np.empty((rows.shape[1] + 1, len(rows)), dtype=self.kind)
        self.operand[:-1] = rows.T
        self.operand[-1] = norms


def near_pairs(
    block: RowBlock, queries: np.ndarray, norms: np.ndarray, limits: np.ndarray, k: int, rounding: float = 0.0
):
    """Positions ``(query, row)`` whose squared distance may be within ``limits`` and among the ``k`` least.

    Distances are only approximated here, with a bound of the error; the caller compares the exact ones,
    which may be rounded by up to ``rounding``.
    """
    count, dim = len(block.rows), queries.shape[1]
    if block.kind is np.float64 or not float(norms.max()) < SINGLE_NORM:
        return near_pairs_double(block, queries, norms, limits, k, rounding)
    left = np.empty((len(queries), dim + 1), dtype=np.float32)
    np.multiply(queries, -2.0, out=left[:, :-1], casting="same_kind")
    left[:, -1] = 1.0
    score = left @ block.operand  # squared distance less the norm of the query
    single = np.finfo(np.float32)
    slack = (dim + 8) * (float(single.eps) * (norms + block.largest) + float(single.tiny)) + rounding
    inside = score <= above(limits - norms + slack)[:, None]
    if count > k and np.count_nonzero(inside) > 2 * k * len(queries):
        least = np.partition(score, k - 1, axis=1)[:, k - 1]
        inside &= score <= above(least + slack + slack)[:, None]
        if count > 16 * k and np.count_nonzero(inside) > inside.size // 8:  # far from the origin, close to each other
            return near_pairs_double(block, queries, norms, limits, k, rounding)
    return np.divmod(np.flatnonzero(inside), count)


def near_pairs_double(block: RowBlock, queries, norms, limits, k: int, rounding: float):
    """:func:`near_pairs` in double precision."""
    approx = norms[:, None] + block.norms[None, :] - 2.0 * (queries @ block.rows.T)
    slack = rounding_slack(norms, block.norms, queries.shape[1]) + rounding
    if len(block.rows) > k:
        limits = np.minimum(limits, np.partition(approx, k - 1, axis=1)[:, k - 1])
    return np.nonzero(approx <= (limits + slack + slack)[:, None])


def above(values: np.ndarray) -> np.ndarray:
    """The next numbers of single precision above ``values``."""
    with np.errstate(over="ignore"):
        return np.nextafter(values.astype(np.float32), np.float32(np.inf))


def lean(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` in single precision where that loses nothing: what is shipped takes half the memory."""
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    return single if np.array_equal(single, vectors) else vectors


def squared_norms(rows: np.ndarray) -> np.ndarray:
    """Squared lengths in double precision, in bounded blocks."""
    out = np.empty(len(rows))
    step = max(1, PAIR_SCRATCH // max(1, rows.shape[1]))
    for start in range(0, len(rows), step):
        part = rows[start : start + step].astype(np.float64, copy=False)
        out[start : start + step] = (part * part).sum(axis=1)
    return out


class BestPerQuery:
    """Running ``k`` smallest ``(distance, id)`` per query over a stream of blocks.

    With ``tagged`` every kept row carries a number beside its id.
    """

    def __init__(self, queries: np.ndarray, k: int, ceiling: np.ndarray | None = None, tagged: bool = False):
        self.queries = queries
        self.norms = squared_norms(queries)
        self.k = k
        self.ceiling = np.full(len(queries), np.inf) if ceiling is None else ceiling
        self.dist = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), NO_ID, dtype=np.int64)
        self.tags = np.zeros((len(queries), k), dtype=np.int32) if tagged else None

    def offer(self, ids: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> None:
        """Score ``rows`` against all queries, or against the positions in ``which``."""
        if len(rows) == 0:
            return
        if which is None:
            which = np.arange(len(self.queries))
        row_norms = (rows * rows).sum(axis=1)
        kept = spare_copies(ids, rows, row_norms, self.k)
        if kept is not None:
            ids, rows, row_norms = ids[kept], rows[kept], row_norms[kept]
        for at in row_steps(len(rows), self.k):
            block, numbers = RowBlock(rows[at], row_norms[at]), ids[at]
            step = max(1, PAIR_SCRATCH // len(numbers))
            for start in range(0, len(which), step):
                self._offer_block(numbers, block, which[start : start + step])

    def _offer_block(self, ids, block, which):
        queries = self.queries[which]
        limits = np.minimum(self.dist[which, -1], self.ceiling[which]) ** 2
        query_pos, row_pos = near_pairs(block, queries, self.norms[which], limits, self.k)
        piece = max(1, PAIR_SCRATCH // block.rows.shape[1])
        for start in range(0, len(query_pos), piece):
            q, r = query_pos[start : start + piece], row_pos[start : start + piece]
            self.merge(which[q], ids[r], pair_distances(queries[q], block.rows[r]))

    def merge(self, which: np.ndarray, ids: np.ndarray, dist: np.ndarray, tag: int = 0) -> None:
        """Offer scored pairs: row ``ids[i]`` at ``dist[i]`` from the query at ``which[i]``."""
        keep = (dist <= self.dist[which, -1]) & (dist <= self.ceiling[which])
        which, ids, dist = which[keep], ids[keep], dist[keep]
        if not len(which):
            return
        if self.k >= WIDE_POOL:
            return self._merge_wide(which, ids, dist, tag)
        touched = np.unique(which)
        fresh = len(which)
        which = np.concatenate([which, np.repeat(touched, self.k)])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        dist = np.concatenate([dist, self.dist[touched].ravel()])
        order = np.lexsort((ids, dist, which))
        which = which[order]
        starts = np.searchsorted(which, touched)
        rank = np.arange(len(which)) - np.repeat(starts, np.diff(np.append(starts, len(which))))
        first = order[rank < self.k]
        self.dist[touched] = dist[first].reshape(len(touched), self.k)
        self.ids[touched] = ids[first].reshape(len(touched), self.k)
        if self.tags is not None:
            tags = np.concatenate([np.full(fresh, tag, dtype=np.int32), self.tags[touched].ravel()])
            self.tags[touched] = tags[first].reshape(len(touched), self.k)

    def _merge_wide(self, which, ids, dist, tag) -> None:
        """:meth:`merge` for large ``k``: kept rows and offers side by side, cut at the ``k``-th without sorting them."""
        if (np.diff(which) < 0).any():
            order = np.argsort(which, kind="stable")
            which, ids, dist = which[order], ids[order], dist[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1])
        counts, touched, k = np.diff(np.append(starts, len(which))), which[starts], self.k
        step = max(1, PAIR_SCRATCH // (k + int(counts.max())))
        for at in range(0, len(touched), step):
            some, many = touched[at : at + step], counts[at : at + step]
            first, last = starts[at], starts[at] + many.sum()
            row = np.repeat(np.arange(len(some)), many)
            column = k + np.arange(last - first) - np.repeat(starts[at : at + step] - first, many)
            shape = (len(some), k + int(many.max()))
            all_dist, all_ids = np.full(shape, np.inf), np.full(shape, NO_ID, dtype=np.int64)
            all_dist[:, :k], all_ids[:, :k] = self.dist[some], self.ids[some]
            all_dist[row, column], all_ids[row, column] = dist[first:last], ids[first:last]
            pick = np.argpartition(all_dist, k - 1, axis=1)[:, :k]
            kth = np.take_along_axis(all_dist, pick[:, -1:], axis=1)
            tied = np.flatnonzero(np.count_nonzero(all_dist <= kth, axis=1) > k)
            if len(tied):  # which of them stay is for the ids to say
                pick[tied] = np.lexsort((all_ids[tied], all_dist[tied]), axis=1)[:, :k]
            self.dist[some] = np.take_along_axis(all_dist, pick, axis=1)
            self.ids[some] = np.take_along_axis(all_ids, pick, axis=1)
            if self.tags is not None:
                all_tags = np.full(shape, tag, dtype=np.int32)
                all_tags[:, :k] = self.tags[some]
                self.tags[some] = np.take_along_axis(all_tags, pick, axis=1)

    def rows(self, part: slice = slice(None)):
        """Arrays ``(query position, id, distance)`` of everything kept for the queries of ``part``, counted from its start."""
        ids, dist = self.ids[part], self.dist[part]
        position, slot = np.nonzero(ids != NO_ID)
        return position, ids[position, slot], dist[position, slot]

    def kept_tags(self, part: slice = slice(None)) -> np.ndarray:
        """The numbers beside the ids, in the order of :meth:`rows`."""
        return self.tags[part][self.ids[part] != NO_ID]


def row_steps(count: int, k: int):
    """Slices of the rows scored at a time: many more than ``k``, so that merges are few."""
    step = max(ROW_STEP, 16 * k)
    return [slice(start, start + step) for start in range(0, count, step)]
