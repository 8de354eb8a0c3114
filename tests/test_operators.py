import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import evaluate, layout, quality, registry
from vectorloom.operators.percentiles import percentile_table
from vectorloom.plans.matrix import Dataset, run_matrix
from vectorloom.streaming import ingest as streaming
from vectorloom.suite.index import ivf_index, pq_index


def vectors(spark, count, dim=4):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=dim).astype(np.float32)]) for i in range(count)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


# --- percentiles --------------------------------------------------------------------------


def test_percentile_known_values(spark):
    one = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    two = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    assert percentile_table(one, [], "v", [50]).head().p50 == 2.0
    assert percentile_table(two, [], "v", [95]).head().p95 == pytest.approx(2.9)


def test_percentiles_with_a_hot_group_and_value(spark):
    pick = random.Random(3)
    rows = [("hot", pick.choice([1.5, pick.random()])) for _ in range(4000)]
    rows += [(f"g{i}", pick.random()) for i in range(40) for _ in range(pick.randrange(1, 6))]
    rows += [("none", None), ("none", None), (None, 2.0), (None, 4.0), (None, None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    cuts = [50, 95, 99, 0, 100]
    builtin = F.percentile("v", F.array(*[F.lit(p / 100) for p in cuts]))
    a = {r.g: r.c for r in frame.groupBy("g").agg(builtin.alias("c")).collect()}
    b = {r.g: tuple(r)[1:] for r in percentile_table(frame, ["g"], "v", cuts).collect()}
    assert a.keys() == b.keys() and b[None][0] == 3.0 and b.pop("none") == (None,) * 5
    for key in b:
        assert b[key] == pytest.approx(a[key], abs=1e-12)


def test_latency_keeps_null_and_empty_groups(spark):
    rows = [("a", 1.0), ("b", None), (None, 3.0)]
    frame = spark.createDataFrame(rows, "s string, elapsed_ms double")
    got = {r.s: (r.queries, r.p50) for r in evaluate.latency_summary(frame, ["s"]).collect()}
    assert got == {"a": (1, 1.0), "b": (0, None), None: (1, 3.0)}


def test_warmup_drops_exactly_its_rows_on_ties(spark):
    rows = [("r", 1, "x"), ("r", 1, "y"), ("r", 1, "y"), ("r", 2, "z"), (None, None, "n"), (None, 5, "m"), ("s", 9, "q")]
    frame = spark.createDataFrame(rows, "run string, at int, v string")
    for warmup, left in ((0, 7), (1, 4), (2, 2), (3, 1), (4, 0)):
        kept = evaluate.without_warmup(frame, ["run"], "at", warmup).collect()
        assert len(kept) == left
    assert {r.v for r in evaluate.without_warmup(frame, ["run"], "at", 1).collect()} == {"y", "z", "m"}


def test_latency_summary(spark):
    times = [12.5, 8.25, 100.0, 3.0]
    frame = spark.createDataFrame([("s", t) for t in times], "s string, elapsed_ms double")
    row = evaluate.latency_summary(frame, ["s"]).head()
    assert (row.sum_ms, row.min_ms, row.max_ms, row.queries) == (sum(times), 3.0, 100.0, 4)
    assert row.mean_ms == pytest.approx(statistics.fmean(times))
    assert row.qps == pytest.approx(4 / (sum(times) / 1000))


# --- recall -------------------------------------------------------------------------------


def test_recall_counts_ties_by_distance(spark):
    base = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 0.0])], "id long, embedding array<float>"
    )
    queries = spark.createDataFrame([(0, [0.0, 0.0])], "query_index long, qvec array<float>")
    truth = spark.createDataFrame([(0, 1, 1)], "query_index long, rk int, id long")
    tied = spark.createDataFrame([(0, 1, 2, 1.0)], "query_index long, rk int, id long, dist double")
    limits = evaluate.thresholds_by_k(truth, queries, base, [1])
    assert limits.head().threshold == pytest.approx(1.001)
    row = evaluate.recall_by_k(tied, truth, limits, [1], 1).head()
    assert (row.recall_id, row.recall_distance) == (0.0, 1.0)
    assert evaluate.below_gate(evaluate.recall_by_k(tied, truth, limits, [1], 1), "recall_id", 1.0).count() == 1


def test_recall_divides_by_all_queries(spark):
    """A query that returned nothing still counts in the denominator."""
    truth = spark.createDataFrame([(q, r, r) for q in (0, 1) for r in (1, 2)], "query_index long, rk int, id long")
    found = spark.createDataFrame([(0, 1, 1, 0.5)], "query_index long, rk int, id long, dist double")
    limits = spark.createDataFrame([(0, 2, 1.0), (1, 2, 1.0)], "query_index long, k int, threshold double")
    row = evaluate.recall_by_k(found, truth, limits, [2], 2).head()
    assert (row.id_hits, row.possible_hits, row.recall_id) == (1, 4, 0.25)
    hits = {r.query_index: r.id_hits for r in evaluate.id_hits(found, truth, 2).collect()}
    assert hits == {0: 1, 1: 0}


def test_recall_beyond_truth_is_null(spark):
    empty = spark.createDataFrame([], "query_index long, rk int, id long, dist double")
    limits = spark.createDataFrame([], "query_index long, k int, threshold double")
    row = evaluate.recall_by_k(empty, empty, limits, [5], 1, gt_width=3).head()
    assert row.recall_id is None and row.possible_hits is None


def test_grid_and_warmup(spark):
    grid = evaluate.scenario_grid(spark, ["index", "fullscan"], [10, 100], [1, 8], 1)
    assert grid.count() == 8
    assert grid.where("label = 'index-k100-dop8-r1'").count() == 1
    with pytest.raises(ValueError):
        evaluate.scenario_grid(spark, ["seq"], [1], [1], 1)
    runs = spark.range(10).withColumnRenamed("id", "statement_no")
    assert evaluate.timed_only(runs, 5, 3).count() == 7
    assert evaluate.timed_only(runs, 5, 100).count() == 5


def test_matrix_runs_all_engines(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = base.select(F.col("id").alias("query_index"), F.col("embedding").alias("qvec"))
    data = Dataset(base, queries, base.count(), 10)
    engines = {"flat": ivf_index(spark, sf_dir), "pq": pq_index(spark, sf_dir), "fullscan": "fullscan"}
    table = run_matrix(data, engines, [1, 10], [1, 8], nprobe=16, warmup=0)
    rows = {(r.engine, r.k, r.dop): r for r in table.collect()}
    assert len(rows) == 8
    assert rows["fullscan", 10, 1].recall_distance == 1.0
    assert rows["flat", 10, 1].recall_id == 1.0
    assert rows["pq", 10, 8].recall_id >= rows["pq", 10, 1].recall_id
    assert all(r.qps > 0 for r in rows.values())


# --- layout -------------------------------------------------------------------------------


def test_table_is_created_once(spark, tmp_path):
    rows = vectors(spark, 50)
    path = layout.table_path(str(tmp_path), "ns", "t")
    layout.create_table(rows, path, buckets=2, dim=4)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        layout.create_table(rows, path, buckets=2, dim=4)
    stored = spark.read.parquet(path)
    quality.require_empty(quality.mixed_files(stored), "files")
    quality.require_empty(quality.bucket_violations(stored, 2), "buckets")
    audit = layout.load_audit(spark, path, "spark", 2).head()
    assert (audit.rows, audit.buckets) == (50, 2) and audit.files >= 2 and audit.bytes > 0


def test_layout_arguments(spark, tmp_path):
    rows = vectors(spark, 5)
    with pytest.raises(ValueError):
        layout.create_table(rows, str(tmp_path / "x"), buckets=-1)
    with pytest.raises(ValueError):
        layout.create_table(rows, str(tmp_path / "x"), buckets=2, compression="gzip")
    with pytest.raises(ValueError):
        layout.table_path("/w", "Bad", "t")
    assert layout.check_compression("gzip", "pyiceberg") == "gzip"


def test_id_lookup_reads_few_rows(spark, tmp_path):
    layout.write_id_clustered(spark.range(100_000), str(tmp_path / "t"), 10)
    found = spark.read.parquet(str(tmp_path / "t")).where("id = 77777")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,77777)" in plan
    files = spark.read.parquet(str(tmp_path / "t")).groupBy("_metadata.file_path").agg(
        F.min("id").alias("a"), F.max("id").alias("b")
    )
    assert files.where("a <= 77777 AND b >= 77777").count() == 1


def test_batches_take_what_remains(spark):
    rows = layout.batch_ranges(spark, 10, 4).orderBy("batch_no").collect()
    assert [(r.first, r.rows) for r in rows] == [(0, 4), (4, 4), (8, 2)]


def test_head_follows_the_latest_version(spark, tmp_path):
    head = str(tmp_path / "head")
    for version in (1, 2, 10):
        spark.range(version).write.parquet(str(tmp_path / f"v{version}"))
        layout.publish(spark, head, "ns", "t", str(tmp_path / f"v{version}"), version)
    assert layout.read_head(spark, head, "ns", "t").count() == 10
    with pytest.raises(ValueError):
        layout.read_head(spark, head, "ns", "other")


# --- gates --------------------------------------------------------------------------------


def test_id_gates(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (5,)], "id long")
    assert [tuple(r) for r in quality.duplicate_ids(rows).collect()] == [(2, 2)]
    assert quality.id_gaps(rows).count() == 1 and quality.id_gaps(spark.range(1, 9)).count() == 0
    assert quality.id_domain_violations(spark.range(1, 9), 8, 1).count() == 0
    assert quality.id_domain_violations(spark.range(1, 9), 8, 0).count() == 1
    assert quality.id_domain_violations(spark.range(0), 8, 0).count() == 1
    with pytest.raises(quality.GateError, match="dup"):
        quality.require_empty(quality.duplicate_ids(rows), "dup")


def test_vector_gate(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None])], "id long, embedding array<float>"
    )
    found = {r.id: r.reason for r in quality.vector_violations(rows, 2).collect()}
    assert found == {2: "wrong dimension", 3: "null vector", 4: "null element"}


def test_schema_gate(spark):
    assert quality.schema_violations(layout.vector_schema(128), 128) == []
    assert quality.schema_violations(layout.vector_schema(960), 128) == ["embedding.vector_dim is 960, expected 128"]
    assert quality.schema_violations(spark.range(1).schema) == ["embedding must be a list"]


def test_size_and_manifest_gates(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(b"\0" * 36)
    (tmp_path / "b.fvecs").write_bytes(b"\0" * 37)
    (tmp_path / "lfs.fvecs").write_bytes(b"version https://git-lfs.github.com/spec/v1\n")
    listing = quality.named_listing(spark, str(tmp_path))
    contract = spark.createDataFrame(
        [("a.fvecs", 8, 1), ("b.fvecs", 8, 1)], "name string, width int, rows long"
    )
    bad = quality.size_violations(listing, contract).collect()
    assert [(r.name, r.trailing_bytes) for r in bad] == [("b.fvecs", 1)]
    assert [r.length for r in quality.pointer_files(spark, str(tmp_path)).collect()] == [43]
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "content"
    )
    import hashlib

    good = hashlib.sha256(b"\0" * 36).hexdigest()
    manifest = spark.createDataFrame(
        [("a.fvecs", good.upper()), ("b.fvecs", good), ("gone", good)], "name string, sha256 string"
    )
    assert {r.name for r in quality.checksum_violations(files, manifest).collect()} == {"b.fvecs", "gone"}
    with pytest.raises(quality.GateError):
        quality.check_vector_files(spark, str(tmp_path / "b.fvecs"), 8, 1)


def test_fingerprint_ignores_order(spark):
    rows = vectors(spark, 200)
    a = quality.fingerprint(rows.repartition(7)).head()
    assert a == quality.fingerprint(rows.orderBy(F.desc("id"))).head()
    changed = rows.withColumn("embedding", F.when(F.col("id") == 9, F.reverse("embedding")).otherwise(F.col("embedding")))
    assert a != quality.fingerprint(changed).head()


# --- registry -----------------------------------------------------------------------------


def registry_rows(spark, path="/wh/t/indices/default/builtin.ivf_pq_v1_segment", size=2, state="active", nbits=8):
    artifact = {"uri": f"file://{path}", "size_bytes": size}
    details = {"dimension": 960, "num_clusters": 1024, "num_sub_quantizers": 60, "nbits": nbits}
    row = {
        "namespace": "ns", "table_name": "t", "table_uuid": "u", "name": "idx_pq", "index_type": "ivf_pq",
        "implementation": "ivf_pq", "state": state,
        "partitions": [{"segments": [{"artifact_files": [artifact], "algorithm_details": details}]}],
    }
    return spark.createDataFrame([row], registry.REGISTRY_SCHEMA)


def problems(spark, rows, name="idx_pq", files=(("/wh/t/indices/default/builtin.ivf_pq_v1_segment", 2),), **expected):
    listing = spark.createDataFrame(list(files), "path string, length long")
    found = registry.active_index_violations(rows, listing, name, "t", "ns", "ivf_pq", "u", **expected)
    return sorted(r.problem for r in found.collect())


def test_active_index_passes_and_fails(spark):
    good = registry_rows(spark)
    assert problems(spark, good, dimension=960, num_sub_quantizers=60, nbits=8) == []
    assert problems(spark, good, nbits=4) == ["nbits"]
    assert problems(spark, good, files=[("/x", 1)]) == ["missing"]
    assert problems(spark, registry_rows(spark, size=3)) == ["size"]
    assert problems(spark, registry_rows(spark, state="building")) == ["state"]
    assert "0 entries" in problems(spark, good, name="other")
    other = "/wh/t/indices/default/builtin.ivf_flat_v2_segment"
    assert problems(spark, registry_rows(spark, other), files=[(other, 2)]) == ["prefix"]


def test_orphans_and_removal(spark):
    listing = spark.createDataFrame(
        [("/wh/t/indices/default/builtin.ivf_pq_v1_segment", 2), ("/wh/t/indices/old", 1)], "path string, length long"
    )
    rows = registry_rows(spark)
    assert [r.path for r in registry.orphans(listing, rows).collect()] == ["/wh/t/indices/old"]
    with pytest.raises(ValueError, match="still holds"):
        registry.removable(listing, rows)
    namesake = rows.withColumn("table_name", F.lit("t2"))
    left = registry.drop_index(rows.unionByName(namesake), "idx_pq", "t", "ns")
    assert [r.table_name for r in left.collect()] == ["t2"]
    states = registry.activate(rows.unionByName(namesake).withColumn("state", F.lit("failed")), "idx_pq", "t2", "ns")
    assert {(r.table_name, r.state) for r in states.collect()} == {("t", "failed"), ("t2", "active")}
    dropped = registry.drop_index(rows, "idx_pq", "t", "ns")
    assert registry.entries_named(dropped, "idx_pq", "t", "ns").head().entries == 0
    assert registry.removable(listing, dropped).count() == 2
    assert registry.orphans(listing, dropped).count() == 2


def test_index_contract_pairs(spark):
    pairs = [("ivf_flat", "ivf"), ("ivf_pq", "ivf_pq"), ("btree", "btree"), ("ivf_flat", "ivf_pq")]
    frame = spark.createDataFrame(pairs, "index_type string, implementation string")
    found = {(r.index_type, r.implementation): r.resolved for r in registry.resolve_contracts(frame).collect()}
    assert list(found[p] for p in pairs) == ["builtin.ivf_flat@2", "builtin.ivf_pq@1", "BTree", None]


# --- streaming ----------------------------------------------------------------------------


def test_stream_ingest_is_incremental_and_rejects_bad_rows(spark, tmp_path):
    source, root = str(tmp_path / "in"), tmp_path / "out"
    rows = vectors(spark, 40)
    bad = spark.createDataFrame([(100, [1.0]), (101, None)], "id long, embedding array<float>")
    rows.where("id < 20").unionByName(bad).repartition(3).write.parquet(source)

    def run():
        stream = streaming.vector_stream(spark, source, files_per_batch=1)
        streaming.ingest(stream, f"{root}/t", f"{root}/r", f"{root}/c", 4, 8).awaitTermination()
        return spark.read.parquet(f"{root}/t")

    assert run().count() == 20
    rows.where("id >= 20").write.mode("append").parquet(source)
    table = run()
    assert table.count() == table.select("id").distinct().count() == 40
    quality.require_empty(quality.bucket_violations(table, 8), "buckets")
    assert sorted(r.id for r in spark.read.parquet(f"{root}/r").collect()) == [100, 101]
