import json
import struct

import pytest
from pyspark.sql import functions as F

from vectorloom.sources import metadata, records
from vectorloom.sources import text as text_source


def fvec(values):
    return struct.pack("<i", len(values)) + struct.pack(f"<{len(values)}f", *values)


def ivec(values):
    return struct.pack("<i", len(values)) + struct.pack(f"<{len(values)}i", *values)


def put(path, *chunks):
    path.write_bytes(b"".join(chunks))
    return str(path)


def test_vectors_and_neighbours_share_their_numbers(spark, tmp_path):
    vectors = [[0.5 * q - d for d in range(6)] for q in range(7)]
    nearest = [[(3 * q + r) % 7 for r in range(5)] for q in range(7)]
    queries = put(tmp_path / "asked.fvecs", *map(fvec, vectors))
    truth = put(tmp_path / "found.ivecs", *map(ivec, nearest))
    rows = records.read_fvecs(spark, queries, 6, id_base=10).orderBy("id").collect()
    assert [(r.id, list(r.embedding)) for r in rows] == [(10 + q, v) for q, v in enumerate(vectors)]
    for k in (1, 3, 5):
        near = records.read_ivecs(spark, truth, 5, k=k, id_base=10).orderBy("query_index").collect()
        assert [list(r.neighbors) for r in near] == [[10 + i for i in n[:k]] for n in nearest]


def test_record_wider_than_a_split(spark, tmp_path):
    path = put(tmp_path / "wide.fvecs", *[fvec([float(q)] * 1500) for q in range(3)])
    rows = records.read_fvecs(spark, path, 1500, id_base=0, split_bytes=1000).collect()
    assert sorted((r.id, r.embedding[1499]) for r in rows) == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_repeated_and_last_ordinals(spark, tmp_path):
    path = put(tmp_path / "eleven.fvecs", *[fvec([i * 0.25, -i]) for i in range(11)])
    wanted = [10, 2, 10, 7, 2, 10]
    rows = records.read_fvecs_at(spark, path, wanted, 2).orderBy("position").collect()
    assert [(r.ordinal, r.embedding[1]) for r in rows] == [(i, -i) for i in wanted]
    with pytest.raises(ValueError, match="no record 11"):
        records.read_fvecs_at(spark, path, [0, 11], 2)


def test_ids_follow_position_across_files_and_splits(spark, tmp_path):
    for part in range(3):
        put(tmp_path / f"p{part}", *[fvec([float(part * 5 + i)] * 4) for i in range(5)])
    for split in (20, 40, 10_000):
        frame = records.read_fvecs(spark, str(tmp_path), 4, id_base=0, split_bytes=split)
        assert frame.where(F.col("embedding")[0] != F.col("id")).count() == 0
        assert frame.count() == 15


def test_id_filters_prune_splits(spark, tmp_path):
    path = put(tmp_path / "b.fvecs", *[fvec([float(i)] * 4) for i in range(100)])
    frame = records.read_fvecs(spark, path, 4, id_base=1, split_bytes=200)
    for condition, wanted in {
        "id >= 95": list(range(95, 101)),
        "id < 4 AND id > 1": [2, 3],
        "id IN (7, 8)": [7, 8],
        "id = 50": [50],
        "id > 100": [],
    }.items():
        found = frame.where(condition)
        assert sorted(r.id for r in found.select("id").collect()) == wanted
        assert found.rdd.getNumPartitions() <= 2


def test_damaged_files_fail(spark, tmp_path):
    cut = put(tmp_path / "cut.fvecs", fvec(range(8)), struct.pack("<i", 8))
    with pytest.raises(Exception, match="not a multiple"):
        records.read_fvecs(spark, cut, 8).collect()
    with pytest.raises(Exception, match="not a multiple"):
        records.record_count(spark, cut, 8).collect()
    wrong = put(tmp_path / "wrong.fvecs", fvec(range(8)), struct.pack("<i", 7) + b"\0" * 32)
    with pytest.raises(Exception, match="record 2 .* has width 7"):
        records.read_fvecs(spark, wrong, 8).collect()
    bad = records.header_violations(spark, wrong, 8, split_bytes=36).collect()
    assert [(r.ordinal, r.header) for r in bad] == [(1, 7)]
    with pytest.raises(ValueError):
        records.read_ivecs(spark, wrong, 8, k=9)


def test_write_and_read_back(spark, tmp_path, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    path = str(tmp_path / "out")
    records.write_records(base.repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id"), path, 64)
    read = records.read_fvecs(spark, path, 64, id_base=0)
    both = read.join(base.withColumnRenamed("embedding", "e"), read.id == base.vec_id)
    assert both.where("embedding = e").count() == base.count() == read.count()


# A banner, ids with blanks, text inside and outside of queries, gaps in the numbers, and a query
# without time.
LOG = """== session 31 ==
__MVP_QUERY_BEGIN_4__
  210
x 5
18
Time: 0.75 ms
__MVP_QUERY_END_4__
640
Time: 77 ms
__MVP_QUERY_BEGIN_6__
__MVP_QUERY_END_6__
__MVP_QUERY_BEGIN_5__
6
Time: 301.0 ms
__MVP_QUERY_END_5__
"""


def test_log_parse(spark, tmp_path):
    (tmp_path / "run.log").write_text(LOG)
    lines = text_source.read_lines(spark, str(tmp_path))
    ids = text_source.returned_ids(lines).orderBy("query_no", "rk").collect()
    assert [(r.query_no, r.rk, r.id) for r in ids] == [(4, 1, 210), (4, 2, 18), (5, 1, 6)]
    times = text_source.statement_times(lines).orderBy("query_no").collect()
    assert [(r.query_no, r.elapsed_ms) for r in times] == [(4, 0.75), (5, 301.0)]
    missing = text_source.queries_without_time(lines, 8).collect()
    assert sorted(r.query_no for r in missing) == [0, 1, 2, 3, 6, 7]
    assert [r.query_no for r in text_source.queries_without_time(lines).collect()] == [6]
    with pytest.raises(ValueError):
        text_source.queries_without_time(lines, 0)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 100])
def test_open_query_crosses_chunks(spark, width):
    lines = spark.createDataFrame(
        [("f", i // width, i, x) for i, x in enumerate(LOG.splitlines())],
        "file string, chunk long, seq long, line string",
    )
    ids = text_source.returned_ids(lines).orderBy("query_no", "rk").collect()
    assert [(r.query_no, r.id) for r in ids] == [(4, 210), (4, 18), (5, 6)]


def test_large_log_keeps_line_order_over_splits(spark, tmp_path):
    body = "".join(
        f"__MVP_QUERY_BEGIN_{q}__\n{q}\n{q + 1}\nTime: {q}.5 ms\n__MVP_QUERY_END_{q}__\n" for q in range(3000)
    )
    (tmp_path / "big.log").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = text_source.read_lines(spark, str(tmp_path))
        assert lines.select("chunk").distinct().count() > 3
        ids = text_source.returned_ids(lines)
        assert ids.where((F.col("id") != F.col("query_no") + F.col("rk") - 1)).count() == 0
        assert ids.count() == 6000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_log_writers_and_sorts_follow_the_size(spark, tmp_path, monkeypatch):
    """Written files hold a bounded number of lines, none of a statement is cut off, and only needed lines are sorted."""
    monkeypatch.setattr(text_source, "FILE_LINES", 500)
    texts = ["__MVP_QUERY_BEGIN_{}__", "17", "noise", "Time: 2.5 ms", "__MVP_QUERY_END_{}__"]
    rows = [(f"run-{q % 3}", q, i, t.format(q)) for q in range(2000) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "run string, event long, seq long, line string").repartition(5)
    text_source.write_lines(lines, str(tmp_path / "logs"), ["run", "event"], ["seq"])
    read = text_source.read_lines(spark, str(tmp_path / "logs"))
    sizes = [r["count"] for r in read.groupBy("file").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 1500 and sum(sizes) == 10_000
    times = text_source.statement_times(read)
    assert times.where("elapsed_ms = 2.5").count() == 2000
    assert {r.query_no for r in times.collect()} == set(range(2000))
    found = text_source.query_lines(read, F.col("line").rlike("^Time"))
    assert found.count() == 2000


def document(**changes):
    base = {
        "format-version": 2,
        "table-uuid": "u",
        "location": "file:///wh/t",
        "current-snapshot-id": 9007199254740993,
        "current-schema-id": 1,
        "schemas": [
            {"schema-id": 0, "fields": []},
            {
                "schema-id": 1,
                "fields": [
                    {"id": 1, "name": "id", "required": True, "type": "long"},
                    {
                        "id": 2,
                        "name": "embedding",
                        "required": True,
                        "type": {"type": "list", "element-id": 3, "element": "float", "element-required": True},
                    },
                ],
            },
        ],
        "properties": {"vector_dim.embedding": "128"},
        "default-spec-id": 0,
        "partition-specs": [
            {
                "spec-id": 0,
                "fields": [
                    {"source-id": 1, "field-id": 1000, "name": "id_bucket", "transform": "bucket[32]"}
                ],
            }
        ],
    }
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v is not None}, indent=1)


def test_metadata_rules(spark, tmp_path):
    from vectorloom.operators.quality import metadata_violations

    base = json.loads(document())
    spec = base["partition-specs"][0]["fields"]
    cases = {
        "good": document(),
        "old_style": document(
            schemas=None, schema=base["schemas"][1], **{"partition-specs": None, "partition-spec": spec, "current-schema-id": None}
        ),
        "int_dim": document(properties={"vector_dim.embedding": 128}),
        "other_dim": document(properties={"vector_dim.embedding": "960"}),
        "no_snapshot": document(**{"current-snapshot-id": None}),
        "v1": document(**{"format-version": 1}),
        "two_specs": document(**{"partition-specs": [{"spec-id": 0, "fields": spec * 2}]}),
        "no_spec": document(**{"partition-specs": [{"spec-id": 0, "fields": []}]}),
    }
    for name, body in cases.items():
        (tmp_path / f"{name}.metadata.json").write_text(body)
    docs = metadata.read_metadata(spark, str(tmp_path))
    name = F.regexp_extract("path", r"([a-z0-9_]+)\.metadata", 1)
    docs = docs.select(name.alias("path"), "document", F.lit(128).alias("dim"), F.lit(32).alias("buckets"))
    current = metadata.current_metadata(docs)
    found = {(r.path, r.rule) for r in metadata_violations(current).collect()}
    assert found == {
        ("int_dim", "dimension property"),
        ("other_dim", "dimension property"),
        ("no_snapshot", "snapshot"),
        ("v1", "format version"),
        ("two_specs", "partition spec"),
        ("no_spec", "partition spec"),
    }
    assert current.where("path = 'good'").head().snapshot_id == 9007199254740993
    plain = metadata.current_metadata(docs.withColumn("buckets", F.lit(0)).where("path IN ('good', 'no_spec')"))
    assert [(r.path, r.rule) for r in metadata_violations(plain).collect()] == [("good", "partition spec")]


def test_latest_metadata_is_numeric_and_obeys_the_hint(spark):
    listing = spark.createDataFrame(
        [("a", f"/a/v{n}.metadata.json", None) for n in (2, 9, 10)]
        + [("b", f"/b/v{n}.metadata.json", 9) for n in (2, 9, 10)]
        + [("c", "/c/v3.metadata.json", 7), ("c", "/c/other.json", 7)],
        "tab string, path string, hint long",
    )
    found = {r.tab: r.version for r in metadata.latest_metadata(listing, ["tab"]).collect()}
    assert found == {"a": 10, "b": 9, "c": 3}


def test_contracts(spark):
    rows = {r.dataset: (r.dim, r.rows, r.queries, r.gt_width) for r in metadata.contract_table(spark).collect()}
    assert rows == {"sift1m": (128, 1_000_000, 10_000, 100), "gist1m": (960, 1_000_000, 1_000, 100)}
    asked = spark.createDataFrame([("gist1m", "spark"), ("sift1m", "rust")], "dataset string, provider string")
    bad = metadata.unsupported_requests(asked, metadata.provider_table(spark)).collect()
    assert [(r.dataset, r.provider) for r in bad] == [("gist1m", "spark")]
