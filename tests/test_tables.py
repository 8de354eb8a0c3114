"""Dense ids, vectors by ordinal, writers from the input size, required columns, summaries of a matrix."""

import json

import pytest
from pyspark.sql import functions as F
from test_search import make

from vectorloom.operators import ids, layout, quality
from vectorloom.plans import matrix
from vectorloom.sources import records


def numbered(df, **options):
    found = ids.dense_ids(df, ["k"], **options)
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[-1])


def test_dense_ids_depend_on_content_alone(spark, monkeypatch):
    rows = [(i % 7, f"v{i % 40}", None if i % 3 else 1.5) for i in range(500)] + [(None, None, None)] * 30 + [(3, "hot", 0.0)] * 400
    df = spark.createDataFrame(rows, "k int, v string, `a.b` double")
    whole = numbered(df.repartition(5), first=10)
    assert [r[-1] for r in whole] == list(range(10, 10 + len(rows)))
    assert sorted(map(repr, (r[:-1] for r in whole))) == sorted(map(repr, rows))
    keys = [(r[0] is not None, r[0] or 0) for r in whole]
    assert keys == sorted(keys)
    monkeypatch.setattr(ids, "CHUNK", 64)
    assert numbered(df.coalesce(1).orderBy(F.desc("v")), first=10) == whole
    assert numbered(df.limit(0)) == []
    with pytest.raises(ValueError, match="'v'"):
        ids.dense_ids(df, ["k"], name="v")


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "fvecs")
    base, frame = make(spark, 3000, dim=6)
    records.write_records(frame.repartitionByRange(4, "id").sortWithinPartitions("id"), path, 6)
    return base, path


def test_ordinals_of_a_table(spark, files):
    base, path = files
    asked = spark.range(200_000).select("id", (F.col("id") * 7919 % 3000).alias("ordinal"))
    asked = asked.unionByName(spark.createDataFrame([(-1, None)], "id long, ordinal long"))
    found = records.read_fvecs_ordinals(path, asked, 6, split_bytes=100 * records.record_bytes(6))
    assert found.count() == 200_000 and found.columns == ["id", "ordinal", "embedding"]
    rows = found.where("id % 1000 = 1").collect()
    assert len(rows) == 200 and all(r.embedding == base[r.ordinal].tolist() for r in rows)
    with pytest.raises(Exception, match="no record 3000"):
        records.read_fvecs_ordinals(path, asked.limit(5).withColumn("ordinal", F.lit(3000)), 6).collect()


def test_ranges_without_ordinals_are_not_opened(spark, files, tmp_path):
    base, path = files
    folder = tmp_path / "damaged"
    folder.mkdir()
    for number, (name, _) in enumerate(records.list_files(path)):
        raw = bytearray(open(name, "rb").read())
        if number != 1:
            raw[:4] = b"\x01\x00\x00\x00"
        (folder / f"part-{number}").write_bytes(bytes(raw))
    starts = [0]
    for _, length in records.list_files(path):
        starts.append(starts[-1] + length // records.record_bytes(6))
    inside = spark.range(starts[1], starts[2]).select(F.col("id").alias("ordinal"))
    assert records.read_fvecs_ordinals(str(folder), inside, 6).count() == starts[2] - starts[1]
    with pytest.raises(Exception, match="width"):
        records.read_fvecs_ordinals(str(folder), spark.range(1).withColumnRenamed("id", "ordinal"), 6).collect()


def test_writers_follow_the_size_of_the_table(spark, tmp_path, monkeypatch):
    _, frame = make(spark, 400, dim=16)
    size = layout.estimated_bytes(frame)
    assert size == 400 * (8 + 4 * 16) and layout.writing_tasks(frame) == 1
    monkeypatch.setattr(layout, "WRITE_TASK_BYTES", size // 5)
    assert layout.writing_tasks(frame) == 5
    layout.create_table(frame, f"{tmp_path}/plain", buckets=0)
    assert len(list((tmp_path / "plain").glob("*.parquet"))) == 5
    layout.create_table(frame, f"{tmp_path}/bucketed", buckets=2, dim=16)
    assert len(list((tmp_path / "bucketed").rglob("*.parquet"))) > 2
    layout.append_in_batches(frame, f"{tmp_path}/batched", 400, 0, 200, 0)
    stored = spark.read.parquet(f"{tmp_path}/batched")
    assert stored.count() == 400 and len(list((tmp_path / "batched").glob("*.parquet"))) > 2
    assert layout.estimated_bytes(frame.limit(0)) == 0


def test_required_columns():
    schema = layout.vector_schema(8)
    assert quality.schema_violations(schema, 8, required=True) == []
    loose = "id must be required", "embedding must be required", "embedding elements must be required"
    for field in schema.fields:
        field.nullable = True
    schema["embedding"].dataType.containsNull = True
    assert quality.schema_violations(schema, 8) == []
    assert tuple(quality.schema_violations(schema, 8, required=True)) == loose


def test_matrix_summary_is_one_document(spark, tmp_path):
    rows = [(e, k, r, 10.0 * k) for e in ("flat", "pq") for k in (10, 1) for r in (2, 1)]
    frame = spark.createDataFrame(rows, "engine string, k int, round int, elapsed_ms double")
    matrix.write_matrix_summary(frame, ["engine", "k", "round"], f"{tmp_path}/summary")
    (file,) = (tmp_path / "summary").glob("*.json")
    document = json.loads(file.read_text())
    assert document["total"] == 8 and document["axes"] == {"engine": ["flat", "pq"], "k": [1, 10], "round": [1, 2]}
    assert [(s["engine"], s["k"], s["round"]) for s in document["scenarios"]] == sorted(r[:3] for r in rows)
