"""Product quantization on top of the inverted lists.

Definitions follow Jegou, Douze, Schmid, "Product Quantization for Nearest Neighbor Search"
(TPAMI 2011): residuals to the coarse centroid, one codebook per sub-vector, asymmetric
distances by table lookup, exact re-ranking of a bounded candidate pool.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.bucket import with_bucket
from vectorloom.functions.vector import l2_distance_batch
from vectorloom.operators import cells
from vectorloom.operators.exact import QueryBlock
from vectorloom.operators.ivf import (
    IvfIndex,
    IvfParams,
    ProbedBlock,
    assigned,
    build_ivf,
    check_shipped,
    groups_of,
    list_cells,
    mean_vectors,
    nearest_lists,
    probed_blocks,
    probed_lists,
    training_sample,
)
from vectorloom.operators.kernel import (
    NO_ID,
    PAIR_SCRATCH,
    ROW_STEP,
    BestPerQuery,
    RowBlock,
    dense_matrix,
    near_pairs,
    nearest_center,
    pair_distances,
    row_steps,
    squared_norms,
    sums_by,
)
from vectorloom.functions.sampling import equidistant_position
from vectorloom.operators.topk import cap_per_worker, check_k, fetch_k, top_per_query
from vectorloom.session import BROADCAST_LIMIT_BYTES, MIB, materialize

CANDIDATES = "query_index long, worker int, list_id int, id long, adc double"

#: Folder of the codes below an index; its prefix is the one the registry asks of code artifacts.
CODES = "builtin.ivf_pq_v1_codes"
#: Memory for the vectors and running pools of the queries one task scores at a time.
TABLE_BYTES = 64 * MIB
#: Bits of the filter of candidate ids: eight per candidate, at most this many (16 MiB).
FILTER_BITS = 1 << 27
#: Decimals of a code distance.
DECIMALS = 9
#: Bytes a candidate takes in a hashed, shipped table.
CANDIDATE_BYTES = 64


@dataclass(frozen=True)
class PqParams:
    num_sub_quantizers: int = 8
    nbits: int = 8
    rounds: int = 10
    buckets: int = 32
    decimals: int = 6

    def check(self, dim: int) -> None:
        if not 1 <= self.nbits <= 8:
            raise ValueError(f"nbits must lie in 1..8, got {self.nbits}")
        if self.num_sub_quantizers < 1 or dim % self.num_sub_quantizers:
            raise ValueError(f"{self.num_sub_quantizers} sub-quantizers do not divide {dim}")

    @property
    def codes(self) -> int:
        return 2**self.nbits


@dataclass(frozen=True)
class PqIndex:
    """Coarse index plus one codebook per sub-vector and a table of codes."""

    ivf: IvfIndex
    params: PqParams
    codebooks: np.ndarray  # sub-quantizer x code x width

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.ivf.path}/{CODES}")


def with_residual(rows: DataFrame, ivf: IvfIndex, vec_col: str, name: str) -> DataFrame:
    """``rows`` of a list with ``name``: the vector less the centroid of its ``list_id``, as doubles.

    Centroids that fit are shipped, those of a tree are joined.
    """
    if ivf.centroids is None:
        joined = rows.join(ivf.centroid_rows(rows.sparkSession).withColumnRenamed("centroid", "__centroid"), "list_id")
        less = F.zip_with(vec_col, "__centroid", lambda x, c: x.cast("double") - c)
        return joined.withColumn(name, less).drop("__centroid")
    centers = check_shipped(ivf.centroids, "centroids")

    @F.arrow_udf("array<double>")
    def less_centroid(vectors: pa.Array, lists: pa.Array) -> pa.Array:
        rows = dense_matrix(vectors, centers.shape[1]) - centers[lists.to_numpy(zero_copy_only=False)]
        return pa.array(list(rows), pa.list_(pa.float64()))

    return rows.withColumn(name, less_centroid(F.col(vec_col), F.col("list_id")))


def train_codebooks(sample: DataFrame, sample_count: int, ivf: IvfIndex, params: PqParams):
    """Lloyd per sub-vector over training residuals, all sub-vectors in each pass."""
    params.check(ivf.dim)
    parts = params.num_sub_quantizers
    placed = assigned(sample.select(F.col("pos").alias("id"), "embedding"), ivf)
    residuals = with_residual(placed, ivf, "embedding", "residual").select(F.col("id").alias("pos"), "residual")
    residuals = materialize(residuals, "residuals")
    if params.codes > sample_count:
        raise ValueError(f"{params.codes} codes need at least as many training rows, got {sample_count}")
    seed = equidistant_position("pos", sample_count, params.codes)
    chosen = residuals.withColumn("seed", seed).where(F.col("seed").isNotNull()).orderBy("seed")
    seeds = dense_matrix(chosen.select("residual").toArrow().column("residual"))  # one row per code
    books = np.round(seeds.reshape(params.codes, parts, -1).transpose(1, 0, 2), params.decimals)
    for _ in range(params.rounds):
        books = codebook_round(residuals, books, params.decimals)
    return books


def codebook_round(residuals: DataFrame, books, decimals: int) -> np.ndarray:
    parts, codes, width = books.shape
    shipped = residuals.sparkSession.sparkContext.broadcast(check_shipped(books, "codebooks"))

    def partial(batches):
        known = shipped.value
        sums, counts = np.zeros_like(known), np.zeros((parts, codes), dtype=np.int64)
        for batch in batches:
            residual = dense_matrix(batch.column(0), parts * width).reshape(-1, parts, width)
            for m in range(parts):
                part, n = sums_by(nearest_center(residual[:, m], known[m]), residual[:, m], codes)
                sums[m] += part
                counts[m] += n
        m, code = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(m, pa.int64()),
                pa.array(code, pa.int64()),
                pa.array(counts[m, code], pa.int64()),
                pa.array(list(sums[m, code]), pa.list_(pa.float64())),
            ],
            names=["m", "code", "n", "sums"],
        )

    sums = residuals.select("residual").mapInArrow(
        partial, "m long, code long, n long, sums array<double>"
    )
    means = mean_vectors(sums, ["m", "code"], decimals).toArrow()
    out = books.copy()
    m, code = means.column("m").to_numpy(), means.column("code").to_numpy()
    out[m, code] = dense_matrix(means.column("center"), width)
    return out


def code_column(books: np.ndarray, residual: str) -> Column:
    """Column ``array<short>``: nearest codeword of every slice of a residual."""
    known = check_shipped(books, "codebooks")

    @F.arrow_udf("array<short>")
    def encode_batch(vectors: pa.Array) -> pa.Array:
        slices = dense_matrix(vectors, known.shape[0] * known.shape[2]).reshape(-1, known.shape[0], known.shape[2])
        codes = np.stack([nearest_center(slices[:, m], known[m]) for m in range(len(known))], axis=1)
        return pa.array(list(codes.astype(np.int16)), pa.list_(pa.int16()))

    return encode_batch(F.col(residual))


def encoded(rows: DataFrame, ivf: IvfIndex, books: np.ndarray, vec_col: str = "embedding") -> DataFrame:
    """``rows`` with ``codes``; works on batch and, with shipped centroids, on streaming frames."""
    named = with_residual(rows, ivf, vec_col, "__residual")
    return named.withColumn("codes", code_column(books, "__residual")).drop("__residual")


def build_pq(
    base: DataFrame,
    ivf_params: IvfParams,
    params: PqParams,
    id_col: str = "id",
    vec_col: str = "embedding",
    ivf: IvfIndex | None = None,
) -> PqIndex:
    """Codes are kept apart from the vectors, so stage one of a search never reads vectors."""
    spark = base.sparkSession
    if ivf is None:
        ivf = build_ivf(base, ivf_params, id_col, vec_col)
    lists = ivf.lists(spark)
    count = lists.count()
    sample = training_sample(lists, count, ivf_params)
    books = train_codebooks(sample, min(count, ivf_params.sample_rows), ivf, params)
    coded = encoded(lists, ivf, books).select("list_id", "id", "codes")
    with_bucket(coded, "id", params.buckets).write.partitionBy("list_id").parquet(
        f"{ivf.path}/{CODES}"
    )
    index = PqIndex(ivf, params, books)
    codebook_table(spark, index).write.parquet(f"{ivf.path}/codebooks")
    return index


def codebook_table(spark: SparkSession, index: PqIndex) -> DataFrame:
    rows = [
        (m, c, [float(x) for x in word])
        for m, book in enumerate(index.codebooks)
        for c, word in enumerate(book)
    ]
    return spark.createDataFrame(rows, "m int, code int, codeword array<double>")


def load_pq(spark: SparkSession, ivf: IvfIndex, params: PqParams) -> PqIndex:
    table = spark.read.parquet(f"{ivf.path}/codebooks").orderBy("m", "code").toArrow()
    words = dense_matrix(table.column("codeword"))
    parts = params.num_sub_quantizers
    return PqIndex(ivf, params, words.reshape(parts, len(words) // parts, -1))


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors the codes stand for, ``rows x dim``."""
    return np.concatenate([book[codes[:, m]] for m, book in enumerate(books)], axis=1)


def code_distances(residuals: np.ndarray, words: np.ndarray, parts: int) -> np.ndarray:
    """Squared distance of residual to decoded vector, pair by pair: a term per sub-quantizer, added in order."""
    diff = residuals - words
    terms = (diff * diff).reshape(len(diff), parts, -1).sum(axis=2)
    total = np.zeros(len(diff))
    for m in range(parts):
        total += terms[:, m]
    return np.round(total, DECIMALS)


def query_bytes(index: PqIndex, pool: int, dop: int) -> int:
    """Memory a task keeps per query: its vector, shipped and as doubles, and its running pools."""
    return 16 * index.ivf.dim + 20 * pool * dop


class CodeScores:
    """Best rows by codes for a bounded group of queries, over all the lists they probe.

    A row's code distance is the distance to the vector its codes stand for, so products find the few pairs
    that may enter a pool, and only these are scored term by term.
    """

    def __init__(self, vectors: np.ndarray, books: np.ndarray, pool: int, dop: int):
        self.vectors, self.books, self.dop = vectors, books, dop
        self.best = BestPerQuery(np.zeros((len(vectors) * dop, 1)), pool, tagged=True)

    def offer(self, ids, workers, codes, which=None, center=0.0, list_id: int = 0) -> None:
        """Rows of one list and its ``center``, for the queries at ``which``."""
        which = np.arange(len(self.vectors)) if which is None else which
        for worker, rows in groups_of(workers):
            for part in row_steps(len(rows), self.best.k):
                at = rows[part]
                words = decoded(codes[at], self.books)
                block = RowBlock(words, squared_norms(words))
                step = max(1, PAIR_SCRATCH // len(at))
                for start in range(0, len(which), step):
                    self._offer_block(ids[at], block, which[start : start + step], worker, center, list_id)

    def _offer_block(self, ids, block, which, worker, center, list_id) -> None:
        residuals, slots = self.vectors[which] - center, which * self.dop + worker
        limits = self.best.dist[slots, -1]
        q, r = near_pairs(block, residuals, squared_norms(residuals), limits, self.best.k, 10.0**-DECIMALS)
        piece = max(1, PAIR_SCRATCH // residuals.shape[1])
        for start in range(0, len(q), piece):
            qs, rs = q[start : start + piece], r[start : start + piece]
            dist = code_distances(residuals[qs], block.rows[rs], len(self.books))
            self.best.merge(slots[qs], ids[rs], dist, list_id)


def candidate_rows(index: np.ndarray, dop: int, best: BestPerQuery):
    """Batches of the kept rows of slots numbered ``query * dop + worker``."""
    step = dop * max(1, cells.BATCH_ROWS // (best.k * dop))
    for start in range(0, len(best.ids), step):
        part = slice(start, start + step)
        position, ids, dist = best.rows(part)
        position = position + start
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(index[position // dop], pa.int64()),
                pa.array((position % dop).astype(np.int32)),
                pa.array(best.kept_tags(part)),
                pa.array(ids, pa.int64()),
                pa.array(dist),
            ],
            names=["query_index", "worker", "list_id", "id", "adc"],
        )


def pq_candidates(index: PqIndex, spark: SparkSession, asked: ProbedBlock, pool: int, dop: int) -> DataFrame:
    """At most ``pool`` rows per query and pool by asymmetric distance.

    With ``dop`` pools, pool ``id_bucket mod dop`` holds the best rows of its buckets alone, so the
    candidates, and with them recall, may grow with ``dop``. The caller bounds the queries by the size of
    their pools; a task ships the best of all lists it reads.
    """
    books, centroids = index.codebooks, index.ivf.centroids
    shipped = spark.sparkContext.broadcast((asked.block.plain(), asked.wanted(), centroids, books))

    def score(batches):
        plain, wanted, centers, books = shipped.value
        queries = QueryBlock(*plain)
        scores = None
        for batch in batches:
            ids, codes = batch.column(0).to_numpy(), dense_matrix(batch.column(1), len(books)).astype(np.int64)
            workers, lists = batch.column(2).to_numpy() % dop, batch.column(3).to_numpy()
            scores = scores or CodeScores(queries.vectors, books, pool, dop)
            for list_id, at in groups_of(lists):
                if list_id in wanted:
                    scores.offer(ids[at], workers[at], codes[at], wanted[list_id], centers[list_id], list_id)
        if scores is not None:
            yield from candidate_rows(queries.index, dop, scores.best)

    rows = probed_lists(index.codes(spark), asked.lists).select("id", "codes", "id_bucket", "list_id")
    return cap_per_worker(rows.mapInArrow(score, CANDIDATES), pool)


class CodeCells:
    """Visitor of cells of codes: the payload of a row is its pool, then its codes."""

    def __init__(self, books: np.ndarray, pool: int, dop: int):
        self.books, self.pool, self.dop = books, pool, dop

    def open(self, list_id: int, packs: list) -> None:
        self.list_id = list_id
        self.index, residuals, _ = cells.joined_packs(packs)
        self.scores = CodeScores(residuals, self.books, self.pool, self.dop)

    def offer(self, ids: bytes, payload: bytes):
        numbers, values = cells.unpack(ids, payload, "<i")
        workers, codes = values[:, 0].astype(np.int64), values[:, 1:].astype(np.int64)
        self.scores.offer(numbers, workers, codes, list_id=self.list_id)
        return ()

    def close(self):
        yield from candidate_rows(self.index, self.dop, self.scores.best)


class CodeSearch:
    """Visitor of whole searches: a group of queries, the codes of all lists, then the vectors of all lists.

    The pools of the group stay in the task that filled them, and are re-ranked as the vectors pass by.
    """

    def __init__(self, centers: np.ndarray, books: np.ndarray, k: int, nprobe: int, dop: int, pool: int):
        self.centers, self.books, self.k = centers, books, k
        self.nprobe, self.dop, self.pool = nprobe, dop, pool

    def open(self, list_id: int, packs: list) -> None:
        self.index, self.vectors, _ = cells.joined_packs(packs)
        lists = nearest_lists(self.vectors, self.centers, self.nprobe)
        place = np.argsort(lists, axis=None, kind="stable")
        flat, position = lists.ravel()[place], place // lists.shape[1]
        cuts = np.flatnonzero(np.diff(flat)) + 1
        self.wanted = {int(group[0]): at for group, at in zip(np.split(flat, cuts), np.split(position, cuts))}
        self.scores = CodeScores(self.vectors, self.books, self.pool, self.dop)
        self.waiting, self.list_id, self.best = [], None, None

    def offer(self, ids: bytes, payload: bytes):
        list_id = int.from_bytes(payload[: cells.LIST_BYTES], "little")
        if list_id in self.wanted:
            if list_id != self.list_id:
                self._score()
            self.list_id = list_id
            self.waiting.append(cells.unpack(ids, payload[cells.LIST_BYTES :], "<i"))
            if sum(len(numbers) for numbers, _ in self.waiting) >= self.dop * max(ROW_STEP, 16 * self.pool):
                self._score()
        return ()

    def _score(self) -> None:
        """Rows of a list wait for others, since a step over many costs few merges."""
        if self.waiting:
            numbers = np.concatenate([numbers for numbers, _ in self.waiting])
            values = np.concatenate([values for _, values in self.waiting]).astype(np.int64)
            where, center = self.wanted[self.list_id], self.centers[self.list_id]
            self.scores.offer(numbers, values[:, 0], values[:, 1:], where, center, self.list_id)
            self.waiting = []

    def _to_rerank(self) -> None:
        self._score()
        kept = self.scores.best
        del self.scores, kept.dist
        position = (np.nonzero(kept.ids != NO_ID)[0] // self.dop).astype(np.int32)
        lists, ids = kept.kept_tags(), kept.ids[kept.ids != NO_ID]
        del kept
        order = np.argsort(ids)
        self.chosen = ids[order], position[order], lists[order]
        self.best = BestPerQuery(self.vectors, self.k)

    def offer_last(self, ids: bytes, payload: bytes):
        if self.best is None:
            self._to_rerank()
        list_id = int.from_bytes(payload[: cells.LIST_BYTES], "little")
        numbers, rows = cells.unpack(ids, payload[cells.LIST_BYTES :])
        chosen, position, lists = self.chosen
        first = np.searchsorted(chosen, numbers, "left")
        count = np.searchsorted(chosen, numbers, "right") - first
        row = np.repeat(np.arange(len(numbers)), count)
        at = np.arange(len(row)) + np.repeat(first - np.cumsum(count) + count, count)
        same = lists[at] == list_id
        row, at = row[same], at[same]
        piece = max(1, PAIR_SCRATCH // rows.shape[1])
        for start in range(0, len(row), piece):
            r, where = row[start : start + piece], position[at[start : start + piece]]
            dist = pair_distances(rows[r].astype(np.float64), self.vectors[where])
            self.best.merge(where.astype(np.int64), numbers[r], dist)
        return ()

    def close(self):
        if self.best is not None:
            yield from cells.kept_batches(self.index, self.best)


def search_groups(index: PqIndex, rows: int, queries: int, k: int, dop: int, pool: int, tasks: int) -> int | None:
    """Groups of queries that each see all codes and vectors, or ``None`` where that copies too much.

    Every group reads each vector once, in place of a row per candidate: worth it while the copies are at
    most twice the candidates.
    """
    state = query_bytes(index, pool, dop) + 16 * k
    groups = max(
        -(-queries * state // cells.QUERY_CELL_BYTES),
        int(rows * queries * index.ivf.dim / cells.CELL_WORK) + 1,
    )
    groups = -(-groups // tasks) * tasks
    fits = index.ivf.centroids is not None and groups * rows <= 2 * queries * pool * dop
    return int(groups) if fits else None


def search_in_groups(
    index: PqIndex, queries: DataFrame, k: int, nprobe: int, dop: int, pool: int, groups: int, pack: int
) -> DataFrame:
    """Pools and re-ranking in one pass: each group of queries meets the codes, then the vectors, of all lists."""
    spark = queries.sparkSession
    nowhere = F.lit(0).cast("long")
    lists = index.ivf.lists(spark)
    number = F.col("list_id").cast("long").alias("list_id")
    owner = F.pmod("id_bucket", F.lit(dop)).cast("short")
    coded = index.codes(spark).select(
        number, nowhere.alias("part"), "id", F.concat(F.array(owner), F.col("codes")).alias("values")
    )
    rows = lists.select(number, nowhere.alias("part"), "id", "embedding")
    group = F.pmod(F.xxhash64("query_index"), F.lit(groups).cast("long"))
    asked = queries.select(nowhere.alias("list_id"), group.alias("part"), "query_index", "qvec")
    asked = asked.repartition(groups, "part")
    base = cells.listed_packs(cells.pack_groups(coded, pack, "<i2", listed=True), groups, 1).unionByName(
        cells.listed_packs(
            cells.pack_groups(rows, pack, cells.layout_of(rows.schema["embedding"].dataType), listed=True), groups, 2
        )
    )
    packed = cells.query_packs(
        cells.pack_groups(asked, pack, cells.layout_of(queries.schema["qvec"].dataType)), F.lit(1).cast("long")
    )
    shipped = spark.sparkContext.broadcast((check_shipped(index.ivf.centroids, "centroids"), index.codebooks))

    def visitor():
        return CodeSearch(*shipped.value, k, nprobe, dop, pool)

    found = cells.meet(base, packed, visitor, cells.CANDIDATES, (groups, F.col("query_group").cast("int")))
    return top_per_query(found, k).select("query_index", "rk", "id", "dist")


def candidates_by_join(
    index: PqIndex, queries: DataFrame, nprobe: int, dop: int, pool: int, pack: int = 2048
) -> DataFrame:
    """:func:`pq_candidates` for query sets too large to ship: codes and query residuals meet in cells."""
    spark = queries.sparkSession
    owner = F.pmod("id_bucket", F.lit(dop)).cast("short")
    coded = index.codes(spark).select("list_id", "id", F.concat(F.array(owner), F.col("codes")).alias("values"))
    row_bytes = 2 * (1 + index.params.num_sub_quantizers)
    sides = list_cells(
        index.ivf, coded, "<i2", queries, nprobe, pack, row_bytes, query_bytes(index, pool, dop),
        lambda asked: with_residual(asked, index.ivf, "qvec", "qvec"),
    )
    books = check_shipped(index.codebooks, "codebooks")
    return cap_per_worker(cells.meet(*sides, lambda: CodeCells(books, pool, dop), CANDIDATES), pool)


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of ``ids(id)`` with two hashes, as words of 64 bits; ``bits`` is bounded."""
    places = F.explode(F.array(*[hashed(F.col("id"), seed, bits) for seed in (0, 1)])).alias("place")
    words = (
        ids.select(places)
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63L as int))")).alias("set"))
        .toArrow()
    )
    out = np.zeros(-(-bits // 64), dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return out.view(np.uint64)


def hashed(value: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(bits).cast("long"))


def may_be_in(spark: SparkSession, words: np.ndarray, bits: int, value: Column) -> Column:
    """Whether a value may be in the filter; of others one in some twenty passes."""
    shipped = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def test(first: pa.Array, second: pa.Array) -> pa.Array:
        known, hit = shipped.value, True
        for places in (first.to_numpy(), second.to_numpy()):
            hit = hit & ((known[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return pa.array(hit)

    return test(hashed(value, 0, bits), hashed(value, 1, bits))


def rerank(
    candidates: DataFrame, ivf: IvfIndex, queries: DataFrame, k: int, path: str = "auto",
    most: int | None = None, probed: np.ndarray | None = None,
) -> DataFrame:
    """Exact distance of every candidate, best ``k`` per query: ``(query_index, rk, id, dist)``.

    Only lists that hold a candidate are read (their partitions are known at run time). On the ``scan``
    path candidates go to the vectors; on the ``join`` path a filter of their ids drops the other vectors
    before both sides are shuffled. ``auto`` decides by the counted candidates; where ``most`` bounds their
    number well below what can be shipped, they need not be written and counted first, and the ``probed``
    lists are those that are read.
    """
    spark = candidates.sparkSession
    wanted = candidates.select("query_index", "list_id", "id")
    small = most is not None and 24 * most <= BROADCAST_LIMIT_BYTES
    if not small:
        wanted = materialize(wanted, "candidates")
        small = path == "scan" or (path == "auto" and 24 * wanted.count() <= BROADCAST_LIMIT_BYTES)
    if small and path != "join":
        lists = ivf.lists(spark).select("list_id", "id", "embedding")
        vectors = pruned_vectors(wanted, ivf, spark) if probed is None else probed_lists(lists, probed)
        hit = vectors.join(F.broadcast(wanted), ["list_id", "id"])
    else:
        vectors, count = pruned_vectors(wanted, ivf, spark), wanted.count()
        bits = int(min(FILTER_BITS, max(64, 8 * count)))
        passing = vectors.where(may_be_in(spark, id_filter(wanted, bits), bits, F.col("id")))
        hit = passing.join(wanted, ["list_id", "id"])
    scored = hit.join(queries.select("query_index", "qvec"), "query_index").select(
        "query_index", "id", l2_distance_batch("embedding", "qvec").alias("dist")
    )
    return top_per_query(scored, k).select("query_index", "rk", "id", "dist")


def pruned_vectors(wanted: DataFrame, ivf: IvfIndex, spark: SparkSession) -> DataFrame:
    """``(list_id, id, embedding)`` of the lists named in ``wanted``, pruned by partition at run time."""
    lists = wanted.select("list_id").distinct().where("list_id >= 0")
    lists = F.broadcast(lists) if 8 * ivf.num_lists <= BROADCAST_LIMIT_BYTES else lists
    return ivf.lists(spark).select("list_id", "id", "embedding").join(lists, "list_id", "left_semi")


def search_pq(
    index: PqIndex,
    queries: DataFrame,
    k: int,
    nprobe: int = 10,
    dop: int = 1,
    pool: int | None = None,
    path: str = "auto",
) -> DataFrame:
    """Probe, rank by codes, keep a pool (or ``dop`` pools by bucket), re-rank exactly.

    ``path`` as in :func:`~vectorloom.operators.ivf.search_ivf`; distances keep the type of the queries on both.
    """
    check_k(k)
    if dop < 1:
        raise ValueError("dop must be positive")
    pool = pool or fetch_k(k)
    per_scan = max(1, TABLE_BYTES // query_bytes(index, pool, dop))
    shipped = index.ivf.centroids is not None
    if path == "auto" and CANDIDATE_BYTES * queries.count() * pool * dop > BROADCAST_LIMIT_BYTES:
        path = "join"
    blocks = probed_blocks(queries, index.ivf, nprobe, per_scan, path if shipped or path == "scan" else "join")
    if blocks is None:
        return search_pq_join(index, queries, k, nprobe, dop, pool)
    if not shipped:
        raise ValueError("the centroids of a tree are not shipped; use the join")
    spark = queries.sparkSession
    found = spark.createDataFrame([], CANDIDATES)
    for number, block in enumerate(blocks):
        part = pq_candidates(index, spark, block, pool, dop).select("query_index", "worker", "list_id", "id", "adc")
        found = part if number == 0 else found.unionByName(part)
    most = sum(len(block.block) for block in blocks) * pool * dop
    probed = np.concatenate([block.lists for block in blocks]) if blocks else np.empty(0, dtype=np.int64)
    return rerank(found, index.ivf, queries, k, most=most, probed=probed)


def search_pq_join(
    index: PqIndex,
    queries: DataFrame,
    k: int,
    nprobe: int,
    dop: int,
    pool: int,
    pack: int = 2048,
    path: str = "auto",
) -> DataFrame:
    """:func:`search_pq` for query sets too large to ship: every step is a join.

    Where the candidates of a group of queries would name most vectors anyway, the group meets the codes and
    the vectors in one task (:func:`search_in_groups`); ``path`` chooses how candidates are re-ranked otherwise.
    """
    if path == "auto":
        tasks = queries.sparkSession.sparkContext.defaultParallelism
        rows = index.ivf.lists(queries.sparkSession).count()
        groups = search_groups(index, rows, queries.count(), k, dop, pool, tasks)
        if groups is not None:
            return search_in_groups(index, queries, k, nprobe, dop, pool, groups, pack)
    return rerank(candidates_by_join(index, queries, nprobe, dop, pool, pack), index.ivf, queries, k, path)
