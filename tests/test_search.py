import os
import subprocess
import sys
import tempfile
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import cells, exact, ivf, pq
from vectorloom.operators.exact import QueryBlock
from vectorloom.operators.kernel import (
    BestPerQuery,
    dense_matrix,
    nearest_center,
    pair_distances,
    spare_copies,
    sums_by,
)
from vectorloom.plans.gate import PlanError, check_plan, plan_text

DIM = 12


def make(spark, count, seed=0, copies=0, dim=DIM):
    """Random vectors; ``copies`` extra rows repeat vector 0 (hot duplicates)."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(count, dim)).astype(np.float32)
    rows = np.concatenate([rows, np.repeat(rows[:1], copies, axis=0)])
    data = [(i, [float(x) for x in row]) for i, row in enumerate(rows)]
    return rows.astype(float), spark.createDataFrame(data, "id long, embedding array<float>")


def as_queries(frame):
    return frame.select(F.col("id").alias("query_index"), F.col("embedding").alias("qvec"))


def brute(base, queries, k):
    out = []
    for q, vector in enumerate(queries):
        dist = np.sqrt(((base - vector) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(len(base)), dist))[:k]
        out += [(q, rk + 1, int(i), float(dist[i])) for rk, i in enumerate(order)]
    return out


def rows_of(frame):
    return [tuple(r) for r in frame.orderBy("query_index", "rk").collect()]


def same(found, expected):
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in found], [r[3] for r in expected], atol=1e-12)


@pytest.fixture(scope="module")
def data(spark):
    base, frame = make(spark, 400, copies=200)
    queries, qframe = make(spark, 25, seed=1)
    queries[3] = base[0]
    qframe = spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(queries)], "query_index long, qvec array<float>"
    )
    return base, frame.repartition(6).cache(), queries, qframe


@pytest.mark.parametrize("k", [1, 7, 300])
def test_batch_with_hot_duplicates(data, k):
    base, frame, queries, qframe = data
    same(rows_of(exact.knn_batch(frame, qframe, k)), brute(base, queries, k))


def test_blocks_equal_brute_force(data):
    base, frame, queries, qframe = data
    same(rows_of(exact.knn_blocks(frame, qframe, 9, pack=7, blocks=5)), brute(base, queries, 9))


def test_paths_agree_on_doubles_and_ties(spark):
    rng = np.random.default_rng(8)
    rows = np.repeat(rng.normal(size=(40, 160)), 3, axis=0)
    frame = spark.createDataFrame([(3 * i + 1, r.tolist()) for i, r in enumerate(rows)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows[::9] + 0.01)], "query_index long, qvec array<double>")
    whole = rows_of(exact.knn_batch(frame, asked, 7))
    assert rows_of(exact.knn_blocks(frame, asked, 7, pack=5, blocks=3)) == whole
    within = sorted(map(tuple, exact.radius_search(frame, asked, 10.0).collect()))
    assert sorted(map(tuple, exact.radius_blocks(frame, asked, 10.0, pack=5, blocks=3).collect())) == within
    built = ivf.build_ivf(frame, ivf.IvfParams(4, 100, 3))
    assert len(built.centroids) == 4
    assert rows_of(ivf.search_ivf_join(built, asked, 7, 4, pack=5)) == whole
    single = exact.knn_single(frame, rows[0] + 0.01, 7).collect()
    assert [(r.id, r.dist) for r in single] == [(i, d) for q, _, i, d in whole if q == 0]


def test_training_counts_ids_with_gaps(spark):
    base, _ = make(spark, 300)
    rows = [(100 + 3 * i, [float(x) for x in r]) for i, r in enumerate(base)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(6)
    sample = ivf.training_sample(frame, 300, ivf.IvfParams(16, 100, 1))
    assert sorted(r.pos for r in sample.collect()) == list(range(100))
    ordinals = ivf.id_ordinals(frame).collect()
    assert sorted((r.id, r.ordinal) for r in ordinals) == [(100 + 3 * i, i) for i in range(300)]
    twice = frame.union(frame)
    with pytest.raises(ValueError, match="ids unique"):
        ivf.build_ivf(twice, ivf.IvfParams(16, 600, 1))


def test_blocks_with_tiny_state(data, monkeypatch):
    base, frame, queries, qframe = data
    monkeypatch.setattr(cells, "QUERY_CELL_BYTES", 4096)
    same(rows_of(exact.knn_blocks(frame, qframe, 9, pack=7, blocks=2)), brute(base, queries, 9))


def test_ceiling_does_not_change_results(data):
    base, frame, queries, qframe = data
    for probe in (frame.where("id < 100"), frame.where("id < 3")):
        same(rows_of(exact.knn_batch(frame, qframe, 5, probe=probe)), brute(base, queries, 5))


def test_large_query_sets_take_the_join(data, monkeypatch):
    base, frame, queries, qframe = data
    monkeypatch.setattr(exact, "fetch_queries", lambda *a, **k: None)
    same(rows_of(exact.knn_batch(frame, qframe, 5)), brute(base, queries, 5))


def test_results_do_not_depend_on_partitions(spark, data):
    base, frame, queries, qframe = data
    expected = rows_of(exact.knn_batch(frame, qframe, 5))
    for parts in (1, 3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert rows_of(exact.knn_batch(frame.repartition(parts), qframe, 5)) == expected
    spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("dim", [DIM, 200])
def test_single_query(spark, dim):
    base, frame = make(spark, 150, dim=dim)
    found = exact.knn_single(frame, base[5], 4).collect()
    assert [r.id for r in found] == [r[2] for r in brute(base, base[5:6], 4)]
    check_plan(exact.knn_single(frame, base[5], 4), "single")


def test_wrong_dimension_fails(spark, data):
    _, _, _, qframe = data
    _, short = make(spark, 10, dim=5)
    with pytest.raises(Exception, match="dimensions"):
        exact.knn_batch(short, qframe, 2).collect()
    with pytest.raises(Exception, match="dimensions"):
        exact.knn_single(short, [0.0] * 6, 2).collect()


def test_k_bounds(data):
    _, frame, _, qframe = data
    for k in (0, 10_001):
        with pytest.raises(ValueError):
            exact.knn_batch(frame, qframe, k)


def test_radius(data):
    base, frame, queries, qframe = data
    radius = 3.5
    expected = sorted(
        (q, i)
        for q, v in enumerate(queries)
        for i in np.flatnonzero(np.sqrt(((base - v) ** 2).sum(axis=1)) <= radius).tolist()
    )
    for found in (
        exact.radius_search(frame, qframe, radius),
        exact.radius_blocks(frame, qframe, radius, pack=7, blocks=3),
    ):
        assert sorted((r.query_index, r.id) for r in found.collect()) == expected


def test_batch_plan_prunes_before_the_shuffle(data):
    _, frame, _, qframe = data
    plan = check_plan(exact.knn_batch(frame, qframe, 5), "batch")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(PlanError):
        check_plan(frame, "batch")


def test_nearest_center_ties_go_low():
    centers = np.array([[1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]])
    assert nearest_center(np.array([[0.0, 5.0], [2.0, 0.0]]), centers).tolist() == [0, 0]


def test_best_per_query_keeps_ids_on_ties():
    best = BestPerQuery(np.zeros((1, 2)), 2)
    best.offer(np.array([9, 4]), np.ones((2, 2)))
    best.offer(np.array([1, 7]), np.ones((2, 2)))
    assert best.rows()[1].tolist() == [1, 4]


def test_copies_beyond_k_are_spared():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(size=(30, 3)), np.ones((40, 3)), -np.ones((40, 3))])
    ids = rng.permutation(len(rows))
    kept = spare_copies(ids, rows, (rows * rows).sum(axis=1), 4)
    assert len(kept) == 30 + 4 + 4 and len(set(kept.tolist())) == len(kept)
    for value in (1.0, -1.0):
        copies = sorted(ids[(rows == value).all(axis=1)].tolist())[:4]
        assert sorted(ids[k] for k in kept if (rows[k] == value).all()) == copies
    few = rng.normal(size=(50, 3))
    assert spare_copies(np.arange(50), few, (few * few).sum(axis=1), 4) is None


def test_nearest_center_with_repeated_centers():
    rng = np.random.default_rng(4)
    centers = np.repeat(rng.normal(size=(5, 6)), 3, axis=0)
    rows = np.concatenate([rng.normal(size=(200, 6)), centers])
    dist = np.round(((rows[:, None] - centers[None]) ** 2).sum(axis=2), 9)
    assert nearest_center(rows, centers).tolist() == dist.argmin(axis=1).tolist()
    sums, counts = sums_by(np.array([2, 0, 2]), rows[:3], 4)
    assert counts.tolist() == [1, 0, 2, 0] and np.allclose(sums[2], rows[0] + rows[2])


def test_dense_matrix_rejects_nulls():
    import pyarrow as pa

    with pytest.raises(ValueError):
        dense_matrix(pa.array([[1.0, None]], pa.list_(pa.float32())))
    with pytest.raises(ValueError):
        dense_matrix(pa.array([[1.0], None], pa.list_(pa.float32())))


# --- indexes ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def index(data):
    _, frame, _, _ = data
    return pq.build_pq(frame, ivf.IvfParams(8, 300, 3), pq.PqParams(4, 4, 2, 8))


def recall(found, expected):
    return len({(r[0], r[2]) for r in found} & {(r[0], r[2]) for r in expected}) / len(expected)


def test_full_probe_is_exact(data, index):
    base, _, queries, qframe = data
    same(rows_of(ivf.search_ivf(index.ivf, qframe, 6, 8)), brute(base, queries, 6))


def test_recall_grows_with_probes(data, index):
    base, _, queries, qframe = data
    expected = brute(base, queries, 6)
    values = [recall(rows_of(ivf.search_ivf(index.ivf, qframe, 6, n)), expected) for n in (1, 3, 8)]
    assert values == sorted(values) and values[-1] == 1.0


def test_lists_hold_every_row_once(spark, data, index):
    base, _, _, _ = data
    lists = index.ivf.lists(spark)
    assert lists.count() == len(base) == lists.select("id").distinct().count()


def test_full_pool_is_exact(data, index):
    base, _, queries, qframe = data
    found = rows_of(pq.search_pq(index, qframe, 6, 8, pool=len(base)))
    same(found, brute(base, queries, 6))


def test_pool_grows_with_dop(data, index):
    base, _, queries, qframe = data
    expected = brute(base, queries, 6)
    values = [recall(rows_of(pq.search_pq(index, qframe, 6, 8, dop=d, pool=8)), expected) for d in (1, 4)]
    assert values[1] >= values[0]


def test_join_paths_agree(data, index):
    _, _, _, qframe = data
    flat = rows_of(ivf.search_ivf(index.ivf, qframe, 6, 3))
    assert rows_of(ivf.search_ivf_join(index.ivf, qframe, 6, 3, pack=5)) == flat
    coded = rows_of(pq.search_pq(index, qframe, 6, 3, dop=2, pool=12))
    assert rows_of(pq.search_pq_join(index, qframe, 6, 3, 2, 12, pack=5)) == coded


def test_index_search_reads_only_probed_lists(spark, data, index):
    _, _, _, qframe = data
    one = qframe.where("query_index = 0")
    plan = check_plan(ivf.search_ivf(index.ivf, one, 3, 2), "index")
    assert "list_id" in plan.split("PartitionFilters")[1][:80]
    (block,) = ivf.probed_blocks(one, index.ivf, 2, 100, "scan")
    codes = pq.pq_candidates(index, spark, block, 5, 1)
    assert "embedding" not in plan_text(codes)


def test_reopened_index(spark, data, index):
    _, _, _, qframe = data
    again = pq.load_pq(spark, ivf.load_ivf(spark, index.ivf.path, index.ivf.params), index.params)
    assert np.array_equal(again.codebooks, index.codebooks)
    assert rows_of(pq.search_pq(again, qframe, 4, 3)) == rows_of(pq.search_pq(index, qframe, 4, 3))


def test_hot_list_is_spread_over_writers(spark, data, monkeypatch):
    """A list with most rows is written by several tasks, and nothing is lost."""
    base, frame, queries, qframe = data
    monkeypatch.setattr(ivf, "LIST_FILE_BYTES", 60 * DIM * 4)
    built = ivf.build_ivf(frame, ivf.IvfParams(4, 300, 2))
    files = built.lists(spark).groupBy("list_id").agg(
        F.count("*").alias("n"), F.countDistinct("_metadata.file_path").alias("files")
    )
    largest = files.orderBy(F.desc("n")).head()
    assert largest.files > 1
    same(rows_of(ivf.search_ivf(built, qframe, 5, 4)), brute(base, queries, 5))


def test_mode_switch(data, index):
    _, frame, _, qframe = data
    exact_rows = rows_of(ivf.search("fullscan", qframe, 3, base=frame))
    assert rows_of(ivf.search("index", qframe, 3, index=index.ivf, nprobe=8)) == exact_rows
    with pytest.raises(ValueError):
        ivf.search("hash", qframe, 3)


def test_parameter_checks(data):
    _, frame, _, _ = data
    with pytest.raises(ValueError):
        ivf.build_ivf(frame, ivf.IvfParams(0))
    with pytest.raises(ValueError):
        pq.PqParams(5, 8).check(12)
    with pytest.raises(ValueError):
        pq.PqParams(4, 9).check(12)


def test_workers_need_no_installed_package(sf_dir):
    """Kernels, broadcasts and data sources work when the package is not on a worker's path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r}); sys.path.insert(0, {root + '/tests'!r})
from pyspark.sql import SparkSession
shared = sys.argv[1]
spark = SparkSession.builder.config("spark.checkpoint.dir", shared).master("local[2]").config(
    "spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from vectorloom.session import new_workdir
assert new_workdir(spark, "x").startswith(shared), new_workdir(spark, "x")
import __spark_entry__ as entry
for name in ("knn_batch", "ivf_pq_search", "fvecs_scan"):
    print(name, entry.queries()[name](spark, {sf_dir!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as folder:
        done = subprocess.run(
            [sys.executable, "-c", code, f"{folder}/shared"], cwd=folder, env=env, capture_output=True, text=True, timeout=300
        )
    assert done.returncode == 0, done.stderr[-3000:]
    assert "knn_batch 5000" in done.stdout


# --- search steps ---------------------------------------------------------------------------


@pytest.mark.parametrize("k", [7, 40])
@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1.0, 3000.0), (1e-25, 0.0), (1e20, 0.0)])
def test_search_steps_lose_no_row(k, scale, offset):
    """Filters in single precision on far, tiny and huge vectors, with ties, against all distances."""
    rng = np.random.default_rng(6)
    rows = (np.round(rng.normal(size=(5000, 6)), 1) + offset) * scale
    ids = rng.permutation(len(rows))
    asked = rows[:30] + 0.05 * scale
    best = BestPerQuery(asked, k)
    for start in range(0, len(rows), 1700):
        best.offer(ids[start : start + 1700], rows[start : start + 1700])
    position, found, dist = best.rows()
    for q in range(len(asked)):
        every = pair_distances(asked[q], rows)
        nearest = np.lexsort((ids, every))[:k]
        assert sorted(found[position == q].tolist()) == sorted(ids[nearest].tolist())
        assert sorted(dist[position == q].tolist()) == every[nearest].tolist()


def test_search_steps_take_little_memory():
    """10,000 rows and 20,000 queries: the matrices of a step are a few megabytes."""
    rng = np.random.default_rng(7)
    rows, asked = rng.normal(size=(10_000, 32)), rng.normal(size=(20_000, 32))
    best = BestPerQuery(asked, 3)
    tracemalloc.start()
    best.offer(np.arange(len(rows)), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_single_precision_is_shipped_where_it_is_whole():
    rows = np.random.default_rng(8).normal(size=(20, 4)).astype(np.float32).astype(np.float64)
    ids = np.arange(20)
    assert QueryBlock(ids, rows).plain()[1].dtype == np.float32
    assert QueryBlock(ids, rows + 1e-12).plain()[1].dtype == np.float64
