"""Column expressions: vectors, bucket transform, sampling, text."""

from vectorloom.functions.bucket import bucket_id, murmur3_long, with_bucket
from vectorloom.functions.sampling import equidistant_position, sample_ordinals
from vectorloom.functions.vector import (
    l2_distance,
    l2_distance_batch,
    parse_vector,
    squared_l2,
    vector_literal,
)

__all__ = [
    "bucket_id",
    "equidistant_position",
    "l2_distance",
    "l2_distance_batch",
    "murmur3_long",
    "parse_vector",
    "sample_ordinals",
    "squared_l2",
    "vector_literal",
    "with_bucket",
]
