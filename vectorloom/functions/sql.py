"""The vector functions for SQL users, as functions Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = {
    "l2_distance": (
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>",
        "DOUBLE",
        "sqrt(aggregate(zip_with(a, b, (x, y) -> pow(cast(x AS DOUBLE) - cast(y AS DOUBLE), 2)), "
        "cast(0 AS DOUBLE), (s, t) -> s + t))",
    ),
    "vec_literal": (
        "v ARRAY<FLOAT>",
        "STRING",
        "concat('[', array_join(transform(v, x -> cast(x AS STRING)), ','), ']')",
    ),
    "vec_parse": ("s STRING", "ARRAY<FLOAT>", "from_json(s, 'array<float>')"),
    "fetch_k": ("k INT", "INT", "least(greatest(k * 5, 50), 10000)"),
}


def _times(value: str, factor: int) -> str:
    return (
        f"((({value} & 65535) * {factor}L + (((shiftrightunsigned({value}, 16) & 65535) * {factor}L) "
        f"& 65535) * 65536L) & 4294967295L)"
    )


def bucket_body() -> str:
    """Bucket transform as nested one-step queries: each step is bound once."""
    from vectorloom.functions.bucket import C1, C2, FINAL_1, FINAL_2, STEP_ADD

    def rotate(value: str, bits: int) -> str:
        return f"((shiftleft({value}, {bits}) | shiftrightunsigned({value}, {32 - bits})) & 4294967295L)"

    def chain(steps: list[str]) -> str:
        body = "x"
        for step in reversed(steps):
            body = f"element_at(transform(array({step}), x -> {body}), 1)"
        return body

    def word(value: str) -> str:
        return chain([f"({value}) & 4294967295L", _times("x", C1), rotate("x", 15), _times("x", C2)])

    stir = f"(({rotate('x', 13)}) * 5 + {STEP_ADD}L) & 4294967295L"
    return chain(
        [
            word("id"),
            stir,
            f"x ^ {word('shiftrightunsigned(id, 32)')}",
            stir,
            "x ^ 8L",
            "x ^ shiftrightunsigned(x, 16)",
            _times("x", FINAL_1),
            "x ^ shiftrightunsigned(x, 13)",
            _times("x", FINAL_2),
            "x ^ shiftrightunsigned(x, 16)",
            "cast((x & 2147483647L) % n AS INT)",
        ]
    )


def register_functions(spark: SparkSession) -> None:
    """Create the temporary SQL functions of this session."""
    every = dict(DEFINITIONS, iceberg_bucket=("id BIGINT, n INT", "INT", bucket_body()))
    for name, (arguments, result, body) in every.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
