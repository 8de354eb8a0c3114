"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vectorloom.operators.kernel import dense_matrix, pair_distances


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def squared_l2(left, right) -> Column:
    """Sum of squared differences, every term widened to double first."""
    terms = F.zip_with(
        _col(left),
        _col(right),
        lambda a, b: (a.cast("double") - b.cast("double"))
        * (a.cast("double") - b.cast("double")),
    )
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def l2_distance(left, right) -> Column:
    """L2 distance as a built-in expression (usable anywhere a column is)."""
    return F.sqrt(squared_l2(left, right))


@F.arrow_udf(DoubleType())
def l2_distance_batch(left, right):
    """L2 distance of two vector columns, one Arrow batch at a time."""
    import pyarrow as pa

    return pa.array(pair_distances(dense_matrix(left), dense_matrix(right)))


def vector_literal(vector) -> Column:
    """``[v1,v2,…]`` text that parses back to the identical float32 values."""
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(_col(vector), lambda x: x.cast("string")), ","),
        F.lit("]"),
    )


def parse_vector(text) -> Column:
    """Inverse of :func:`vector_literal`."""
    return F.from_json(_col(text), "array<float>")


def subvector(vector, part: int, width: int) -> Column:
    """Slice number ``part`` of ``width`` dimensions (zero-based)."""
    return F.slice(_col(vector), part * width + 1, width)
