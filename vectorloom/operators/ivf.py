"""Inverted-file index: coarse quantizer, inverted lists, probed search.

A quantizer that fits a broadcast is shipped to the tasks. A larger one becomes a tree: its centroids
are the rows of a smaller index, so that finding the list of a row, or the lists to probe for a query, is
itself a probed search (assign to coarse cells, then within them by a join) and no matrix is shipped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.functions.sampling import equidistant_position
from vectorloom.operators import cells
from vectorloom.operators.cells import CANDIDATES, kept_batches
from vectorloom.operators.exact import (
    MAX_SCANS,
    STATE_LIMIT_BYTES,
    QueryBlock,
    check_path,
    columns_of,
    fetch_queries,
    knn_batch,
)
from vectorloom.operators.kernel import (
    SCRATCH,
    BestPerQuery,
    dense_matrix,
    nearest_center,
    rounding_slack,
    sums_by,
)
from vectorloom.operators.topk import check_k, top_per_query
from vectorloom.session import BROADCAST_LIMIT_BYTES, MIB, materialize, new_workdir

#: Folder of the lists below an index; its prefix is the one the registry asks of list artifacts.
LISTS = "builtin.ivf_flat_v2_lists"
#: Bytes of vectors one written file of an inverted list should hold.
LIST_FILE_BYTES = 256 * MIB
#: Bytes of training vectors one task scans per round.
TRAIN_TASK_BYTES = 8 * MIB
#: Coarse cells a tree searches for the nearest centroid of a row.
TREE_PROBES = 4
#: Bytes of list rows that meet one group of queries at most.
LIST_CELL_BYTES = 256 * MIB


@dataclass(frozen=True)
class IvfParams:
    num_clusters: int = 256
    sample_rows: int = 100_000
    rounds: int = 10
    decimals: int = 6

    def check(self) -> None:
        if min(self.num_clusters, self.sample_rows, self.rounds) < 1:
            raise ValueError("num_clusters, sample_rows and rounds must be positive")


@dataclass(frozen=True)
class IvfIndex:
    """Centroids as an array that can be shipped, or as the rows of ``tree``; lists as a partitioned table."""

    params: IvfParams
    centroids: np.ndarray | None
    path: str
    sample_lists: np.ndarray
    tree: IvfIndex | None = None

    @property
    def dim(self) -> int:
        return self.tree.dim if self.centroids is None else self.centroids.shape[1]

    @property
    def num_lists(self) -> int:
        return len(self.sample_lists)

    def centroid_rows(self, spark: SparkSession) -> DataFrame:
        """``(list_id, centroid)``"""
        return spark.read.parquet(f"{self.path}/centroids").select("list_id", "centroid")

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{LISTS}")


def check_shipped(array: np.ndarray, what: str) -> np.ndarray:
    if array.nbytes > BROADCAST_LIMIT_BYTES:
        raise ValueError(f"{what} take {array.nbytes} bytes, above the broadcast limit")
    return array


def total_rows(base: DataFrame) -> int:
    return base.count()


def id_ordinals(base: DataFrame) -> DataFrame:
    """``(id, ordinal)``: the rank of every id from 0, without sorting all ids in one task.

    Ids are numbered inside range partitions, after the counts of the partitions before.
    """
    ranged = materialize(
        base.select("id").repartitionByRange("id").withColumn("slice", F.spark_partition_id()), "ids"
    )
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = ranged.groupBy("slice").count().select(
        "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")
    )
    inside = F.row_number().over(W.partitionBy("slice").orderBy("id")) - 1
    numbered = ranged.withColumn("at", inside).join(offsets, "slice")
    return numbered.select("id", (F.col("first") + F.col("at")).alias("ordinal"))


def training_sample(base: DataFrame, rows: int, params: IvfParams) -> DataFrame:
    """Equidistant rows ``(pos, embedding)``, written once so that rounds rescan only them.

    Positions count the ids in order, whatever gaps they have and wherever they start.
    """
    params.check()
    wanted = min(rows, params.sample_rows)
    pos = equidistant_position("ordinal", rows, wanted)
    chosen = id_ordinals(base).select("id", pos.alias("pos")).where(F.col("pos").isNotNull())
    sample = base.select("id", "embedding").join(chosen, "id").select("pos", "embedding")
    dim = base.select(F.size("embedding").alias("dim")).head().dim
    tasks = max(1, -(-wanted * dim * 4 // TRAIN_TASK_BYTES))
    return materialize(sample.repartition(tasks, "pos"), "sample")


def seed_rows(sample: DataFrame, sample_count: int, count: int) -> np.ndarray:
    """``count`` equidistant sample rows, in order."""
    if count > sample_count:
        raise ValueError(f"{count} centers need at least as many training rows, got {sample_count}")
    seed = equidistant_position("pos", sample_count, count)
    rows = sample.withColumn("seed", seed).where(F.col("seed").isNotNull())
    seeds = dense_matrix(rows.orderBy("seed").toArrow().column("embedding"))
    if len(seeds) != count:
        raise ValueError(f"{len(seeds)} training rows instead of {count}; are the ids unique?")
    return seeds


def lloyd_round(sample: DataFrame, centers: np.ndarray, decimals: int) -> np.ndarray:
    """One k-means update. Tasks send per-center sums, never rows; empty centers stay."""
    shipped = sample.sparkSession.sparkContext.broadcast(check_shipped(centers, "centroids"))

    def partial(batches):
        known = shipped.value
        sums, counts = np.zeros_like(known), np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            rows = dense_matrix(batch.column(0), known.shape[1])
            part, n = sums_by(nearest_center(rows, known), rows, len(known))
            sums += part
            counts += n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int64()),
                pa.array(counts[used], pa.int64()),
                pa.array(list(sums[used]), pa.list_(pa.float64())),
            ],
            names=["list_id", "n", "sums"],
        )

    parts = sample.select("embedding").mapInArrow(partial, "list_id long, n long, sums array<double>")
    means = mean_vectors(parts, ["list_id"], decimals).toArrow()
    out = centers.copy()
    out[means.column("list_id").to_numpy()] = dense_matrix(means.column("center"))
    return out


def mean_vectors(parts: DataFrame, keys: list[str], decimals: int) -> DataFrame:
    """Rounded mean vector per key from partial ``(n, sums)`` rows, one per key and task.

    Vectors are added whole. The exact sum of each component makes the result independent of
    how the rows were partitioned.
    """
    kinds = ", ".join(f"{k} long" for k in keys)

    def merge(group: pa.Table) -> pa.Table:
        sums = dense_matrix(group.column("sums"))
        count = sum(group.column("n").to_pylist())
        center = [round(math.fsum(column) / count, decimals) for column in sums.T.tolist()]
        first = {k: [group.column(k)[0].as_py()] for k in keys}
        return pa.table(
            {**{k: pa.array(v, pa.int64()) for k, v in first.items()}, "center": pa.array([center], pa.list_(pa.float64()))}
        )

    return parts.groupBy(*keys).applyInArrow(merge, f"{kinds}, center array<double>")


def train_centroids(sample: DataFrame, sample_count: int, params: IvfParams) -> np.ndarray:
    """Deterministic Lloyd: equidistant seeds, fixed rounds, rounded centers."""
    centers = np.round(seed_rows(sample, sample_count, params.num_clusters), params.decimals)
    for _ in range(params.rounds):
        centers = lloyd_round(sample, centers, params.decimals)
    return centers


def train_centroids_mllib(sample: DataFrame, params: IvfParams, seed: int = 42) -> np.ndarray:
    """Coarse quantizer by Spark ML's parallel k-means instead of fixed seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = sample.select(array_to_vector(F.col("embedding")).alias("features"))
    model = KMeans(k=params.num_clusters, maxIter=params.rounds, seed=seed).fit(features)
    return np.array(model.clusterCenters())


def nearest_list(centroids: np.ndarray, vec_col: str = "embedding") -> Column:
    """Column: number of the nearest centroid (works on batch and streaming frames)."""
    known = check_shipped(centroids, "centroids")

    @F.arrow_udf("int")
    def assign(vectors: pa.Array) -> pa.Array:
        rows = dense_matrix(vectors, known.shape[1])
        return pa.array(nearest_center(rows, known).astype(np.int32))

    return assign(F.col(vec_col))


def build_ivf(
    base: DataFrame,
    params: IvfParams,
    id_col: str = "id",
    vec_col: str = "embedding",
    path: str | None = None,
    carry: tuple[str, ...] = (),
    trainer=None,
) -> IvfIndex:
    """Train on a sample, then assign and write every row in one pass over the base."""
    spark = base.sparkSession
    rows = columns_of(base, id_col, vec_col, *carry)
    count = total_rows(rows)
    sample = training_sample(rows, count, params)
    sample_count = min(count, params.sample_rows)
    path = path or new_workdir(spark, "ivf")
    dim = rows.select(F.size("embedding").alias("dim")).head().dim
    tree = None
    if trainer is not None:
        centroids = trainer(sample, params)
    elif params.num_clusters * dim * 8 > BROADCAST_LIMIT_BYTES and params.num_clusters > 4:
        centroids, centers = None, train_tree(sample, sample_count, params)
        tree = build_tree(centers, params, f"{path}/tree")
    else:
        centroids = train_centroids(sample, sample_count, params)
    lists = params.num_clusters if centroids is None else len(centroids)
    index = IvfIndex(params, centroids, path, np.zeros(lists, dtype=np.int64), tree)
    placed = assigned(sample.select(F.col("pos").alias("id"), "embedding"), index)
    sizes = placed.groupBy("list_id").count().toArrow()  # a number per list
    index.sample_lists[sizes.column("list_id").to_numpy()] = sizes.column("count").to_numpy()
    write_lists(assigned(rows, index), index, count)
    stored = centers if centroids is None else centroid_table(spark, index)
    shares = spark.createDataFrame(
        pa.table({"list_id": pa.array(np.arange(lists), pa.int32()), "sample_rows": pa.array(index.sample_lists)})
    )
    stored.join(shares, "list_id").withColumn("in_tree", F.lit(tree is not None)).write.parquet(f"{path}/centroids")
    return index


def build_tree(centers: DataFrame, params: IvfParams, path: str) -> IvfIndex:
    """Index of the centroids themselves, with as many cells as centroids per cell."""
    coarse = replace(params, num_clusters=max(2, math.isqrt(params.num_clusters)))
    rows = centers.select(F.col("list_id").cast("long").alias("id"), F.col("centroid").alias("embedding"))
    return build_ivf(rows, coarse, path=path)


def train_tree(sample: DataFrame, sample_count: int, params: IvfParams) -> DataFrame:
    """Lloyd as in :func:`train_centroids` with the centroids as a table ``(list_id, centroid)``.

    In each round a tree over the centroids finds the nearest one of every training row.
    """
    spark, count = sample.sparkSession, params.num_clusters
    if count > sample_count:
        raise ValueError(f"{count} centers need at least as many training rows, got {sample_count}")
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), params.decimals))
    seeds = sample.select(equidistant_position("pos", sample_count, count).alias("seed"), rounded.alias("centroid"))
    centers = materialize(
        seeds.where(F.col("seed").isNotNull()).select(F.col("seed").cast("int").alias("list_id"), "centroid"), "centers"
    )
    for _ in range(params.rounds):
        index = IvfIndex(params, None, "", np.zeros(count), build_tree(centers, params, new_workdir(spark, "tree")))
        placed = assigned(sample.select(F.col("pos").alias("id"), "embedding"), index)
        means = mean_vectors(list_sums(placed), ["list_id"], params.decimals)
        moved = centers.join(means.withColumn("list_id", F.col("list_id").cast("int")), "list_id", "left")
        centers = materialize(moved.select("list_id", F.coalesce("center", "centroid").alias("centroid")), "centers")
    return centers


def list_sums(placed: DataFrame) -> DataFrame:
    """``(list_id, n, sums)`` of the rows of each batch."""

    def partial(batches):
        for batch in batches:
            lists, slot = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            sums, counts = sums_by(slot, dense_matrix(batch.column(1)), len(lists))
            yield pa.record_batch(
                {
                    "list_id": pa.array(lists, pa.int64()), "n": pa.array(counts, pa.int64()),
                    "sums": pa.array(list(sums), pa.list_(pa.float64())),
                }
            )

    return placed.select("list_id", "embedding").mapInArrow(partial, "list_id long, n long, sums array<double>")


def assigned(rows: DataFrame, index: IvfIndex) -> DataFrame:
    """``rows(id, embedding, …)`` with the number of the nearest list."""
    if index.centroids is not None:
        return rows.withColumn("list_id", nearest_list(index.centroids))
    asked = rows.select(F.col("id").alias("query_index"), F.col("embedding").alias("qvec"))
    found = search_ivf_join(index.tree, asked, 1, TREE_PROBES)
    return rows.join(found.select(F.col("query_index").alias("id"), F.col("id").cast("int").alias("list_id")), "id")


def write_lists(placed: DataFrame, index: IvfIndex, count: int) -> None:
    """Write rows partitioned by list, by id inside a file.

    A list expected to be large (its share of the training sample times the row count) is
    spread over several writers, so one list may hold any share of the table. The share only
    sets the number of files; every row is written whatever it says. Small lists share tasks.
    """
    spark, dim = placed.sparkSession, index.dim
    share = index.sample_lists / max(1, index.sample_lists.sum())
    writers = np.maximum(1, np.ceil(share * count * dim * 4 / LIST_FILE_BYTES)).astype(np.int64)
    large = np.flatnonzero(writers > 1)
    spread = spark.createDataFrame(
        pa.table({"list_id": pa.array(large, pa.int32()), "__writers": pa.array(writers[large], pa.int64())})
    )
    known = placed.join(spread, "list_id", "left")
    salted = known.withColumn("__salt", F.pmod(F.xxhash64("id"), F.coalesce("__writers", F.lit(1))))
    size = -(-count * dim * 4 // LIST_FILE_BYTES)
    cores = spark.sparkContext.defaultParallelism
    partitions = int(min(writers.sum(), max(size, cores)))
    (
        salted.repartition(partitions, "list_id", "__salt")
        .sortWithinPartitions("list_id", "id")
        .drop("__salt", "__writers")
        .write.partitionBy("list_id")
        .option("maxRecordsPerFile", max(1, LIST_FILE_BYTES // (dim * 4)))
        .parquet(f"{index.path}/{LISTS}")
    )


def centroid_table(spark: SparkSession, index: IvfIndex) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(index.centroids)]
    return spark.createDataFrame(rows, "list_id int, centroid array<double>")


def load_ivf(spark: SparkSession, path: str, params: IvfParams) -> IvfIndex:
    """Open a written index; a new probe count needs no rebuild."""
    stored = spark.read.parquet(f"{path}/centroids")
    shares = stored.select("list_id", "sample_rows", "in_tree").orderBy("list_id").toArrow()
    sample_lists, in_tree = shares.column("sample_rows").to_numpy(), shares.column("in_tree")[0].as_py()
    params = replace(params, num_clusters=len(sample_lists))
    if in_tree:
        tree = load_ivf(spark, f"{path}/tree", replace(params, num_clusters=1))
        return IvfIndex(params, None, path, sample_lists, tree)
    centroids = dense_matrix(stored.select("list_id", "centroid").orderBy("list_id").toArrow().column("centroid"))
    return IvfIndex(params, centroids, path, sample_lists)


def list_sizes(index: IvfIndex, spark: SparkSession) -> DataFrame:
    """Rows per inverted list; reads no column, only partition values and row counts."""
    return index.lists(spark).groupBy("list_id").agg(F.count("*").alias("n"))


def nearest_lists(rows: np.ndarray, centers: np.ndarray, count: int, decimals: int = 9) -> np.ndarray:
    """The ``count`` nearest centers of every row by rounded squared distance, lowest number first on ties.

    Only centers that may be among them are compared exactly; rows are taken in bounded blocks.
    """
    if count < 1:
        raise ValueError("nprobe must be positive")
    count = min(count, len(centers))
    norms = (centers * centers).sum(axis=1)
    out = np.empty((len(rows), count), dtype=np.int64)
    step = max(1, SCRATCH // len(centers))
    for start in range(0, len(rows), step):
        block = rows[start : start + step]
        own = (block * block).sum(axis=1)
        approx = block @ (-2.0 * centers.T) + norms + own[:, None]
        slack = rounding_slack(own, norms, rows.shape[1]) + 10.0**-decimals
        limit = np.partition(approx, count - 1, axis=1)[:, count - 1] + 2.0 * slack
        row, center = np.nonzero(approx <= limit[:, None])
        exact = np.empty(len(row))
        piece = max(1, SCRATCH // rows.shape[1])
        for at in range(0, len(row), piece):
            diff = block[row[at : at + piece]] - centers[center[at : at + piece]]
            exact[at : at + piece] = np.round((diff * diff).sum(axis=1), decimals)
        order = np.lexsort((center, exact, row))
        first = np.searchsorted(row[order], np.arange(len(block)))
        out[start : start + step] = center[order][first[:, None] + np.arange(count)]
    return out


def probe_table(queries: DataFrame, index, nprobe: int) -> DataFrame:
    """Probe choice as rows ``(query_index, list_id, probe_rank)``, made by the tasks that hold the queries.

    ``index``: an index, or the centroids as an array.
    """
    if nprobe < 1:
        raise ValueError("nprobe must be positive")
    if isinstance(index, IvfIndex) and index.centroids is None:
        per_cell = max(1, index.num_lists // index.tree.num_lists)
        coarse = min(index.tree.num_lists, max(TREE_PROBES, 2 * nprobe // per_cell + 1))
        found = search_ivf_join(index.tree, queries, min(nprobe, index.num_lists), coarse)
        return found.select("query_index", F.col("id").cast("int").alias("list_id"), F.col("rk").alias("probe_rank"))
    known = check_shipped(index.centroids if isinstance(index, IvfIndex) else index, "centroids")

    @F.arrow_udf("array<int>")
    def nearest(vectors: pa.Array) -> pa.Array:
        rows = dense_matrix(vectors, known.shape[1])
        return pa.array(list(nearest_lists(rows, known, nprobe).astype(np.int32)), pa.list_(pa.int32()))

    picked = queries.select("query_index", nearest("qvec").alias("lists"))
    return picked.select("query_index", F.posexplode("lists").alias("pos", "list_id")).select(
        "query_index", "list_id", (F.col("pos") + 1).alias("probe_rank")
    )


@dataclass
class ProbedBlock:
    """Queries that are shipped, and which of them probe which list."""

    block: QueryBlock
    lists: np.ndarray
    positions: np.ndarray

    def wanted(self) -> dict[int, np.ndarray]:
        order = np.argsort(self.lists, kind="stable")
        lists, positions = self.lists[order], self.positions[order]
        cuts = np.flatnonzero(np.diff(lists)) + 1
        groups = zip(np.split(lists, cuts), np.split(positions, cuts))
        return {int(group[0]): where for group, where in groups if len(group)}


def probed_blocks(queries: DataFrame, index: IvfIndex, nprobe: int, per_scan: int, path: str):
    """Queries to be shipped in blocks of at most ``per_scan``, each with its probes, or ``None``.

    The tasks choose the probes; what is fetched is a pair of numbers per query and probe. ``path`` is
    ``scan``, ``join``, or ``auto``: scan while few scans with shipped queries and probes do.
    """
    check_path(path, "join")
    if path == "join":
        return None
    block = fetch_queries(queries)
    many = block is not None and (
        len(block) > per_scan * MAX_SCANS or 16 * len(block) * min(nprobe, index.num_lists) > BROADCAST_LIMIT_BYTES
    )
    if block is None or (many and path == "auto"):
        if path == "scan":
            raise ValueError("too many queries to ship; use the join")
        return None
    if not len(block):
        return []
    probes = probe_table(queries, index, nprobe).toArrow()
    lists = probes.column("list_id").to_numpy()
    positions = np.searchsorted(block.index, probes.column("query_index").to_numpy())
    out = []
    for start in range(0, len(block), per_scan):
        inside = (positions >= start) & (positions < start + per_scan)
        out.append(ProbedBlock(block.part(slice(start, start + per_scan)), lists[inside], positions[inside] - start))
    return out


def groups_of(values: np.ndarray):
    """Yield ``(value, row positions)`` for each distinct value of a batch column."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(values[rows[0]]), rows


def probed_lists(lists: DataFrame, probes: np.ndarray) -> DataFrame:
    """Only the partitions some query probes (static partition pruning)."""
    return lists.where(F.col("list_id").isin([int(x) for x in np.unique(probes)]))


def search_ivf(index: IvfIndex, queries: DataFrame, k: int, nprobe: int = 10, path: str = "auto") -> DataFrame:
    """Approximate top-``k``: probe ``nprobe`` lists, exact distance inside them.

    On the ``scan`` path probes are shipped to the scan of the lists, so list rows are never shuffled and a
    hot list is simply more scan tasks; on the ``join`` path lists and queries meet in cells. ``auto`` scans
    while the queries are few. The rows are the same. Probing every list gives the exact result.
    """
    check_k(k)
    blocks = probed_blocks(queries, index, nprobe, max(1, STATE_LIMIT_BYTES // (16 * k)), path)
    if blocks is None:
        return search_ivf_join(index, queries, k, nprobe)
    found = queries.sparkSession.createDataFrame([], CANDIDATES)
    for number, block in enumerate(blocks):
        part = probe_scan(index, queries.sparkSession, block, k)
        found = part if number == 0 else found.unionByName(part)
    return top_per_query(found, k).select("query_index", "rk", "id", "dist")


def cell_counts(index: IvfIndex, sizes: DataFrame, probes: DataFrame, row_bytes: int, state_bytes: int) -> DataFrame:
    """``(list_id, row_groups, query_groups)`` of every probed list, from its rows and its queries.

    One row per list. A large list gets several row groups, a list that many queries probe several
    query groups, so either may hold any share without becoming one task.
    """
    asked = probes.groupBy("list_id").agg(F.count("*").alias("asked")).where("asked > 0")
    counts = sizes.join(asked, "list_id").select(
        "list_id",
        F.greatest(F.lit(1), F.ceil(F.col("n") * row_bytes / LIST_CELL_BYTES)).cast("long").alias("row_groups"),
        F.greatest(F.lit(1), F.ceil(F.col("asked") * state_bytes / cells.QUERY_CELL_BYTES)).cast("long").alias("query_groups"),
    )
    small = 24 * index.num_lists <= BROADCAST_LIMIT_BYTES
    counts = materialize(counts, "cells")
    return F.broadcast(counts) if small else counts


def list_cells(
    index: IvfIndex, rows: DataFrame, layout: str, queries: DataFrame, nprobe: int, pack: int, row_bytes: int,
    state_bytes: int, shape=None,
) -> tuple[DataFrame, DataFrame]:
    """Packs of list rows ``(list_id, id, values)`` and of the queries that probe them, for :func:`cells.meet`.

    ``shape`` may change the vector ``qvec`` of ``(list_id, part, query_index, qvec)`` by its list.

    Unprobed lists are left out by the join with the probed ones, at run time by partition.
    """
    probes = materialize(probe_table(queries, index, nprobe).select("query_index", "list_id"), "probes")
    counts = cell_counts(index, list_sizes(index, queries.sparkSession), probes, row_bytes, state_bytes)
    values = [c for c in rows.columns if c not in ("list_id", "id")][0]
    one = F.lit(0).cast("long").alias("part")
    # The groups of a list are the same for all its rows; packs take them from a second, small join.
    left = rows.join(counts.where("row_groups > 0").select("list_id"), "list_id", "left_semi")
    packed = cells.pack_groups(left.select(F.col("list_id").cast("long").alias("list_id"), one, "id", values), pack, layout)
    left = cells.row_packs(packed.join(counts, "list_id"), F.col("row_groups"), F.col("query_groups"))

    group = F.pmod(F.xxhash64("query_index"), F.col("query_groups")).alias("part")
    asked = probes.join(counts, "list_id").select(F.col("list_id").cast("long").alias("list_id"), group, "query_index")
    asked = asked.join(queries.select("query_index", "qvec"), "query_index").repartition("list_id", "part")
    asked = asked.select("list_id", "part", "query_index", "qvec")
    asked = asked if shape is None else shape(asked).select(asked.columns)
    packed = cells.pack_groups(asked, pack, cells.layout_of(asked.schema["qvec"].dataType))
    right = cells.query_packs(packed.join(counts.select("list_id", "row_groups"), "list_id"), F.col("row_groups"))
    return left, right


def search_ivf_join(index: IvfIndex, queries: DataFrame, k: int, nprobe: int = 10, pack: int = 2048) -> DataFrame:
    """:func:`search_ivf` for query sets too large to ship: lists and queries meet in cells."""
    check_k(k)
    rows = index.lists(queries.sparkSession).select("list_id", "id", "embedding")
    layout = cells.layout_of(rows.schema["embedding"].dataType)
    sides = list_cells(index, rows, layout, queries, nprobe, pack, int(layout[-1]) * index.dim, 8 * index.dim + 16 * k)
    found = cells.meet(*sides, lambda: cells.Nearest(k), CANDIDATES)
    return top_per_query(found, k).select("query_index", "rk", "id", "dist")


def probe_scan(index: IvfIndex, spark: SparkSession, asked: ProbedBlock, k: int) -> DataFrame:
    shipped = spark.sparkContext.broadcast((asked.block.plain(), asked.wanted()))

    def score(batches):
        plain, wanted = shipped.value
        queries = QueryBlock(*plain)
        best = BestPerQuery(queries.vectors, k)
        dim = queries.vectors.shape[1]
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), dense_matrix(batch.column(1), dim)
            for list_id, where in groups_of(batch.column(2).to_numpy()):
                if list_id in wanted:
                    best.offer(ids[where], rows[where], wanted[list_id])
        yield from kept_batches(queries.index, best)

    rows = probed_lists(index.lists(spark), asked.lists).select("id", "embedding", "list_id")
    return rows.mapInArrow(score, CANDIDATES)


def scan_fraction(index: IvfIndex, queries: DataFrame, nprobe: int) -> DataFrame:
    """Share of all rows that each query's probes cover."""
    sizes = list_sizes(index, queries.sparkSession)
    rows = sizes.agg(F.sum("n").alias("rows")).head().rows
    probes = probe_table(queries, index, nprobe)
    return (
        probes.join(sizes, "list_id")
        .groupBy("query_index")
        .agg((F.sum("n") / F.lit(rows)).alias("scan_fraction"))
    )


def search(
    mode: str,
    queries: DataFrame,
    k: int,
    base: DataFrame | None = None,
    index=None,
    nprobe: int = 10,
    **options,
) -> DataFrame:
    """One entry point for both modes: ``index`` (probed) and ``fullscan`` (exact)."""
    if mode == "fullscan":
        return knn_batch(base, queries, k, **options)
    if mode != "index":
        raise ValueError(f"unknown mode {mode!r}; use index or fullscan")
    if isinstance(index, IvfIndex):
        return search_ivf(index, queries, k, nprobe, **options)
    from vectorloom.operators.pq import search_pq

    return search_pq(index, queries, k, nprobe, **options)
