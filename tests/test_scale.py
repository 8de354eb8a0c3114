"""Search beyond what can be shipped: grids, trees of centroids, pruned re-ranking, paths that agree."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import brute, make, rows_of, same

from vectorloom.operators import cells, exact, ivf, pq
from vectorloom.plans.gate import plan_text


def clustered(spark, groups, per_group, dim=8, seed=5, kind="float"):
    """Well separated groups of vectors; the group of row ``i`` is ``i % groups``."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim)) * 100
    rows = np.concatenate([centers + rng.normal(size=(groups, dim)) for _ in range(per_group)])
    rows = rows.astype(np.float32).astype(float) if kind == "float" else rows
    data = [(i, r.tolist()) for i, r in enumerate(rows)]
    return rows, spark.createDataFrame(data, f"id long, embedding array<{kind}>").repartition(6)


def asked(spark, rows, kind="float"):
    data = [(i, r.tolist()) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"query_index long, qvec array<{kind}>")


# --- grid -----------------------------------------------------------------------------------


def test_grid_shape_copies_the_smaller_side():
    assert cells.grid_shape(10**9, 512, 10**4, 512, 600, 1000) == (1000, 1)
    row_groups, query_groups = cells.grid_shape(10**6, 512, 10**6, 512, 600, 64)
    assert (row_groups, query_groups) == (8, 9)  # memory asks for nine groups of queries
    assert cells.grid_shape(10**6, 512, 10**6, 512, 60, 64) == (8, 8)
    row_groups, query_groups = cells.grid_shape(10**10, 512, 10**8, 512, 100_000, 10)
    assert query_groups * cells.QUERY_CELL_BYTES >= 10**8 * 100_000 and row_groups == 1


def test_copies_are_bounded_by_the_grid(spark):
    base, frame = make(spark, 300)
    queries, _ = make(spark, 40, seed=2)
    qframe = asked(spark, queries)
    plan = exact.GridPlan(5, 3, 16)
    left, right = exact.grid_sides(frame, qframe, plan)
    ids = F.octet_length("ids") / 8
    assert left.agg(F.sum(ids)).head()[0] == 300 * 3 and right.agg(F.sum(ids)).head()[0] == 40 * 5
    assert right.select("row_group", "query_group").distinct().count() == 15
    found = exact.in_cells(frame, qframe, plan, 4)
    text = plan_text(found)
    assert "Join" not in text and "CartesianProduct" not in text
    assert found.count() <= 40 * 4 * plan.row_groups


def test_first_round_ships_less_and_changes_nothing(spark):
    base, frame = make(spark, 2000, dim=4)
    queries, _ = make(spark, 30, seed=2, dim=4)
    qframe = asked(spark, queries)
    expected = brute(base, queries, 5)
    same(rows_of(exact.knn_blocks(frame, qframe, 5, pack=20, blocks=32, first_round=0)), expected)
    same(rows_of(exact.knn_blocks(frame, qframe, 5, pack=20, blocks=32)), expected)
    plan = exact.plan_grid(frame, qframe, 80, 20, 32)
    assert plan.row_groups >= 16
    part = brute(base, queries, 5)
    ceiling = {q: d for q, rk, _, d in part if rk == 5}
    bounded = qframe.join(
        spark.createDataFrame([(q, d * 1.5) for q, d in ceiling.items()], "query_index long, ceiling double"), "query_index"
    )
    free = exact.in_cells(frame, qframe, plan, 5).count()
    few = exact.in_cells(frame, bounded, plan, 5).count()
    assert few < free / 3


def test_paths_are_arguments(spark):
    base, frame = make(spark, 200)
    queries, _ = make(spark, 10, seed=2)
    qframe = asked(spark, queries)
    expected = brute(base, queries, 4)
    for path in ("auto", "scan", "grid"):
        same(rows_of(exact.knn_batch(frame, qframe, 4, path=path)), expected)
    with pytest.raises(ValueError, match="path"):
        exact.knn_batch(frame, qframe, 4, path="join")
    built = ivf.build_ivf(frame, ivf.IvfParams(4, 100, 2))
    for path in ("auto", "scan", "join"):
        same(rows_of(ivf.search_ivf(built, qframe, 4, 4, path)), expected)
    assert rows_of(ivf.search_ivf(built, qframe.limit(0), 4, 4)) == []
    assert rows_of(ivf.search_ivf(built, qframe.limit(0), 4, 4, "join")) == []
    with pytest.raises(ValueError, match="path"):
        ivf.search_ivf(built, qframe, 4, 4, "grid")


# --- probes and trees -----------------------------------------------------------------------


def test_nearest_lists_keep_ties_in_order():
    rng = np.random.default_rng(3)
    centers = np.repeat(rng.normal(size=(20, 6)), 2, axis=0)
    rows = np.concatenate([rng.normal(size=(50, 6)), centers[:5]])
    dist = np.round(((rows[:, None] - centers[None]) ** 2).sum(axis=2), 9)
    for count in (1, 3, 40, 100):
        expected = np.argsort(dist, axis=1, kind="stable")[:, :count]
        assert ivf.nearest_lists(rows, centers, count).tolist() == expected.tolist()
    with pytest.raises(ValueError):
        ivf.nearest_lists(rows, centers, 0)


def test_cells_of_a_list_follow_its_rows_and_queries(spark, monkeypatch):
    rows, frame = clustered(spark, 4, 100)
    built = ivf.build_ivf(frame, ivf.IvfParams(4, 400, 3))
    qframe = asked(spark, np.concatenate([rows[:4], np.repeat(rows[:1], 60, axis=0)]))
    expected = rows_of(ivf.search_ivf(built, qframe, 5, 2, "scan"))
    monkeypatch.setattr(ivf, "LIST_CELL_BYTES", 30 * 8 * 4)
    monkeypatch.setattr(cells, "QUERY_CELL_BYTES", 10 * (8 * 8 + 16 * 5))
    probes = ivf.probe_table(qframe, built, 2)
    counts = ivf.cell_counts(built, ivf.list_sizes(built, spark), probes, 8 * 4, 8 * 8 + 16 * 5).collect()
    assert {r.row_groups for r in counts} == {4} and max(r.query_groups for r in counts) >= 6
    assert rows_of(ivf.search_ivf(built, qframe, 5, 2, "join")) == expected


def test_a_tree_equals_the_flat_quantizer_on_separated_data(spark, monkeypatch):
    rows, frame = clustered(spark, 25, 20)
    params = ivf.IvfParams(25, 500, 1)
    flat = ivf.build_ivf(frame, params)
    qframe = asked(spark, rows[:40])
    expected = rows_of(ivf.search_ivf(flat, qframe, 5, 2, "scan"))
    monkeypatch.setattr(ivf, "BROADCAST_LIMIT_BYTES", 20 * 8 * 8)
    built = ivf.build_ivf(frame, params)
    assert built.centroids is None and built.tree.num_lists == 5 and built.num_lists == 25 and built.dim == 8
    stored = np.array([r.centroid for r in built.centroid_rows(spark).orderBy("list_id").collect()])
    assert np.allclose(stored, flat.centroids)
    lists = {r.id: r.list_id for r in built.lists(spark).collect()}
    assert lists == {r.id: r.list_id for r in flat.lists(spark).collect()}
    assert rows_of(ivf.search_ivf(built, qframe, 5, 2, "scan")) == expected
    assert rows_of(ivf.search_ivf(built, qframe, 5, 2, "join")) == expected
    again = ivf.load_ivf(spark, built.path, params)
    assert again.centroids is None and again.sample_lists.tolist() == built.sample_lists.tolist()
    assert rows_of(ivf.search_ivf(again, qframe, 5, 2)) == expected
    coded = pq.build_pq(frame, params, pq.PqParams(4, 4, 1, 8), ivf=built)
    assert rows_of(pq.search_pq(coded, qframe, 5, 2, pool=200)) == expected
    with pytest.raises(ValueError):
        pq.search_pq(coded, qframe, 5, 2, pool=40, path="scan")


def test_recall_of_a_tree_on_random_data(spark, monkeypatch):
    """Lists found by the tree against the nearest of all centroids, on data without structure."""
    base, frame = make(spark, 1500, dim=6)
    monkeypatch.setattr(ivf, "BROADCAST_LIMIT_BYTES", 60 * 6 * 8)
    built = ivf.build_ivf(frame, ivf.IvfParams(64, 1500, 1))
    centers = np.array([r.centroid for r in built.centroid_rows(spark).orderBy("list_id").collect()])
    nearest = ivf.nearest_lists(base, centers, 1)[:, 0]
    found = {r.id: r.list_id for r in built.lists(spark).collect()}
    assert len(found) == 1500 and np.mean([found[i] == nearest[i] for i in range(1500)]) >= 0.9
    probes = ivf.probe_table(asked(spark, base[:200]), built, 8).collect()
    wanted = ivf.nearest_lists(base[:200], centers, 8)
    hits = sum(p.list_id in wanted[p.query_index] for p in probes)
    assert len(probes) == 1600 and hits / 1600 >= 0.9


# --- codes ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def doubles(spark):
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(400, 8))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, embedding array<double>")
    built = pq.build_pq(frame, ivf.IvfParams(8, 400, 3), pq.PqParams(4, 4, 2, 8))
    return rows, frame, built


def test_double_queries_agree_on_all_paths(spark, doubles):
    rows, frame, built = doubles
    qframe = asked(spark, rows[:20] + 0.1, "double")
    exact_rows = rows_of(exact.knn_batch(frame, qframe, 3))
    for path in ("scan", "join"):
        assert rows_of(pq.search_pq(built, qframe, 3, 8, pool=400, path=path)) == exact_rows
    scanned = rows_of(pq.search_pq(built, qframe, 3, 3, pool=10, path="scan"))
    assert rows_of(pq.search_pq(built, qframe, 3, 3, pool=10, path="join")) == scanned
    assert rows_of(pq.search_pq_join(built, qframe, 3, 3, 1, 10, path="join")) == scanned


def test_reranking_reads_only_lists_of_candidates(spark, doubles):
    rows, _, built = doubles
    one = asked(spark, rows[:1], "double")
    (block,) = ivf.probed_blocks(one, built.ivf, 2, 10, "scan")
    candidates = pq.pq_candidates(built, spark, block, 5, 1)
    wanted = candidates.select("list_id", "id")
    vectors = pq.pruned_vectors(wanted, built.ivf, spark)
    assert "dynamicpruning" in plan_text(vectors).lower()
    read = {r.list_id for r in vectors.select("list_id").distinct().collect()}
    assert read == {r.list_id for r in wanted.collect()} and len(read) <= 2
    assert "dynamicpruning" in plan_text(pq.rerank(candidates, built.ivf, one, 3)).lower()
    static = plan_text(pq.rerank(candidates, built.ivf, one, 3, most=5, probed=block.lists))
    assert "PartitionFilters: [list_id" in static and "dynamicpruning" in static.lower()


def test_id_filter_passes_candidates_and_few_others(spark):
    ids = spark.range(0, 40_000, 40)
    bits = 8 * 1000
    words = pq.id_filter(ids, bits)
    passing = {r.id for r in spark.range(40_000).where(pq.may_be_in(spark, words, bits, F.col("id"))).collect()}
    assert set(range(0, 40_000, 40)) <= passing and len(passing) < 1000 + 0.12 * 39_000


def test_many_queries_on_one_list_stay_in_bounds(spark, doubles, monkeypatch):
    """50,000 queries on one list: they are cut into groups whose tables fit, on both paths."""
    rows, _, built = doubles
    rng = np.random.default_rng(1)
    data = [(i, (rows[0] + d).tolist()) for i, d in enumerate(rng.normal(size=(50_000, 8)) * 0.01)]
    qframe = spark.createDataFrame(data, "query_index long, qvec array<double>").repartition(8)
    size = pq.query_bytes(built, 5, 1)
    monkeypatch.setattr(pq, "TABLE_BYTES", size * 20_000)
    monkeypatch.setattr(cells, "QUERY_CELL_BYTES", size * 20_000)
    blocks = ivf.probed_blocks(qframe, built.ivf, 1, pq.TABLE_BYTES // size, "auto")
    assert [len(b.block) for b in blocks] == [20_000, 20_000, 10_000]
    probes = ivf.probe_table(qframe, built.ivf, 1)
    counts = ivf.cell_counts(built.ivf, ivf.list_sizes(built.ivf, spark), probes, 10, size)
    assert max(r.query_groups for r in counts.collect()) >= 3
    scanned = pq.search_pq(built, qframe, 1, 1, pool=5, path="scan")
    joined = pq.search_pq(built, qframe, 1, 1, pool=5, path="join")
    assert scanned.exceptAll(joined).isEmpty() and scanned.count() == joined.count() == 50_000


def test_tables_and_scores_are_built_in_blocks():
    rng = np.random.default_rng(2)
    books = rng.normal(size=(4, 16, 2))
    tracemalloc.start()
    scores = pq.CodeScores(rng.normal(size=(4000, 8)), books, 5, 1)
    for start in range(0, 40_000, 10_000):
        ids = np.arange(start, start + 10_000)
        scores.offer(ids, np.zeros(10_000, dtype=np.int64), rng.integers(0, 16, size=(10_000, 4)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6  # the whole matrix of scores would be 1.3 GB
    assert len(scores.best.rows()[1]) == 4000 * 5


def test_groups_search_without_candidates_on_the_way(spark, doubles, monkeypatch):
    """Pools are re-ranked in the task that filled them: no candidate is written, and a query ships k rows."""
    rows, _, built = doubles
    qframe = asked(spark, rows[:60] + 0.1, "double")
    expected = rows_of(pq.search_pq(built, qframe, 3, 8, dop=2, pool=40, path="scan"))
    narrow = rows_of(pq.search_pq(built, qframe, 3, 3, dop=2, pool=7, path="scan"))
    shipped = []
    meet = cells.meet

    def counted(*arguments):
        found = meet(*arguments)
        shipped.append(found.count())
        return found

    def refuse(*_):
        raise AssertionError("candidates are written")

    monkeypatch.setattr(cells, "meet", counted)
    monkeypatch.setattr(pq, "materialize", refuse)
    assert rows_of(pq.search_pq_join(built, qframe, 3, 8, 2, 40)) == expected
    assert shipped == [60 * 3]
    found = pq.search_in_groups(built, qframe, 3, 3, 2, 7, groups=5, pack=16)
    assert rows_of(found) == narrow


def test_groups_are_taken_while_they_copy_little(spark, doubles):
    _, _, built = doubles
    assert pq.search_groups(built, 400, 1000, 3, 1, 50, 8) == 8
    assert pq.search_groups(built, 10**9, 1000, 3, 1, 50, 8) is None
    many = pq.search_groups(built, 10**6, 10**7, 3, 4, 50, 8)
    assert many % 8 == 0 and 10**7 / many * pq.query_bytes(built, 50, 4) <= cells.QUERY_CELL_BYTES


def test_code_distances_equal_sums_over_tables():
    rng = np.random.default_rng(5)
    books, residuals = rng.normal(size=(4, 16, 2)), rng.normal(size=(50, 8))
    codes = rng.integers(0, 16, size=(50, 4))
    tables = ((residuals.reshape(50, 4, 1, 2) - books[None]) ** 2).sum(axis=3)
    summed = np.round(sum(tables[np.arange(50), m, codes[:, m]] for m in range(4)), 9)
    assert np.array_equal(pq.code_distances(residuals, pq.decoded(codes, books), 4), summed)
