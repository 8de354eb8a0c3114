import random

import pytest
from pyspark.sql import functions as F

from vectorloom.functions import bucket_id, murmur3_long, with_bucket
from vectorloom.functions import text
from vectorloom.functions.sampling import equidistant_position, sample_ordinals, sample_position
from vectorloom.functions.sql import register_functions
from vectorloom.functions.vector import l2_distance, l2_distance_batch, parse_vector, vector_literal
from vectorloom.operators.topk import fetch_k


def murmur(value: int) -> int:
    """Plain murmur3 x86_32 of eight little-endian bytes, seed 0."""
    word, data = 0xFFFFFFFF, (value & (1 << 64) - 1).to_bytes(8, "little")
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & word
    h = 0
    for at in (0, 4):
        k = int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & word
        h ^= rot(k, 15) * 0x1B873593 & word
        h = (rot(h, 13) * 5 + 0xE6546B64) & word
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & word
    h = (h ^ h >> 13) * 0xC2B2AE35 & word
    return h ^ h >> 16


def test_bucket_known_values(spark):
    known = {34: 19, 0: 28, 1: 4, 1_000_000: 6, -1: 8}
    ids = spark.createDataFrame([(k,) for k in known], "id long")
    rows = ids.select("id", murmur3_long("id").alias("h"), bucket_id("id", 32).alias("b")).collect()
    assert {r.id: r.b for r in rows} == known
    assert [r.h for r in rows if r.id == 34] == [2017239379]


def test_bucket_matches_plain_hash(spark):
    pick = random.Random(7)
    ids = [pick.randrange(-(2**63), 2**63) for _ in range(500)] + [-(2**63), 2**63 - 1, 0]
    frame = with_bucket(spark.createDataFrame([(i,) for i in ids], "id long"), "id", 32)
    for row in frame.collect():
        assert row.id_bucket == (murmur(row.id) & 0x7FFFFFFF) % 32


def test_bucket_filter_stays_cheap(spark):
    """A filter on the bucket must not be rewritten into one giant expression."""
    frame = with_bucket(spark.range(100), "id", 32).where("id_bucket = 3")
    assert len(frame._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_bucket_count_checked():
    with pytest.raises(ValueError):
        bucket_id("id", 0)


def test_equidistant_reference_values(spark):
    rows = sample_ordinals(spark, 10_000, 100, "equidistant").orderBy("position").collect()
    assert [r.ordinal for r in rows] == list(range(0, 10_000, 101))
    one = sample_ordinals(spark, 10_000, 1, "equidistant").collect()
    assert [r.ordinal for r in one] == [0]


@pytest.mark.parametrize("total,count", [(10, 10), (10, 7), (97, 13), (1000, 3), (5, 2), (1, 1), (8, 1)])
def test_equidistant_predicate_equals_list(spark, total, count):
    expected = {i * (total - 1) // (count - 1): i for i in range(count)} if count > 1 else {0: 0}
    position = equidistant_position("id", total, count)
    rows = spark.range(-3, total + 3).select("id", position.alias("p")).where("p IS NOT NULL").collect()
    assert {r.id: r.p for r in rows} == expected


def test_sampling_bounds(spark):
    with pytest.raises(ValueError):
        sample_ordinals(spark, 5, 6, "first")
    with pytest.raises(ValueError):
        sample_position("id", 5, 2, "random")


def test_distance_and_literal(spark):
    values = [0.1, -2.5e-8, 3.4028235e38, 1 / 3]
    frame = spark.createDataFrame([(values, [0.0, 1.0, 0.0, 0.0])], "a array<float>, b array<float>")
    row = frame.select(
        parse_vector(vector_literal("a")).eqNullSafe(F.col("a")).alias("same"),
        l2_distance("a", "a").alias("zero"),
        l2_distance("a", "b").alias("x"),
        l2_distance_batch("a", "b").alias("y"),
    ).head()
    assert row.same and row.zero == 0.0 and row.x == pytest.approx(row.y)


def test_sql_functions_agree(spark):
    register_functions(spark)
    rows = spark.sql("SELECT id, iceberg_bucket(id, 32) AS b FROM range(-50, 50)").collect()
    assert all(r.b == (murmur(r.id) & 0x7FFFFFFF) % 32 for r in rows)
    assert spark.sql("SELECT fetch_k(10) AS a, fetch_k(3) AS b, fetch_k(9000) AS c").head() == (50, 50, 10_000)


def test_fetch_k():
    assert [fetch_k(k) for k in (1, 10, 100, 10_000)] == [50, 50, 500, 10_000]


def test_setting_lines(spark):
    lines = ["export A=1", "  # x", "B = 'q=1' ", "nope", "", 'export C=""', "=v"]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    pairs = [r.p for r in frame.select(text.setting_key_value("line").alias("p")).collect()]
    assert [tuple(p) if p else None for p in pairs] == [
        ("A", "1"), None, ("B", "q=1"), None, None, ("C", ""), ("", "v"),
    ]


def test_positive_int_lists(spark):
    frame = spark.createDataFrame([("10, 100,1",), ("1,x",), ("0,1",), ("",), ("-4",)], "s string")
    found = [r.p for r in frame.select(text.positive_ints("s").alias("p")).collect()]
    assert found == [[10, 100, 1], None, None, None, None]


def test_locations(spark):
    wanted = {
        "/a/b": "/a/b",
        "file:///a/b%20c+d": "/a/b c+d",
        "file:/x": "/x",
        "file://localhost/y": "/y",
        "file://host/y": None,
        "http://q/w": None,
        "rel/x": None,
    }
    frame = spark.createDataFrame([(k,) for k in wanted], "s string")
    found = {r.s: r.p for r in frame.select("s", text.local_path("s").alias("p")).collect()}
    assert found == wanted


def test_labels_and_markers(spark):
    row = spark.range(1).select(
        text.scenario_label(F.lit("index"), F.lit(10), F.lit(2), F.lit(1)).alias("label"),
        text.missing_markers(F.lit("Vector SEARCH on t"), ["vector search", "Local Gather"]).alias("m"),
        text.metadata_version(F.lit("/t/metadata/v12.metadata.json")).alias("v"),
        text.metadata_version(F.lit("/t/metadata/12.metadata.json")).alias("none"),
        text.is_identifier(F.lit("sift_1m")).alias("ok"),
        text.is_identifier(F.lit("Sift-1")).alias("bad"),
    ).head()
    assert row == ("index-k10-dop2-r1", ["Local Gather"], 12, None, True, False)
