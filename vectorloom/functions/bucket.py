"""Table-format bucket transform: Murmur3 (x86, 32 bit) of the id as 8 bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published Murmur3 x86_32 hash.
C1 = 0xCC9E2D51
C2 = 0x1B873593
STEP_ADD = 0xE6546B64
FINAL_1 = 0x85EBCA6B
FINAL_2 = 0xC2B2AE35

_WORD = 0xFFFFFFFF


def _word(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_WORD))


def _times(value: Column, factor: int) -> Column:
    """32-bit product kept in BIGINT; split in halves so that ANSI mode never overflows."""
    low = value.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)
    high = (F.shiftrightunsigned(value, 16) * F.lit(factor)).bitwiseAND(F.lit(0xFFFF))
    return _word(low + high * F.lit(65536))


def _rotate(value: Column, bits: int) -> Column:
    return _word(F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 32 - bits)))


def _fold(value: Column, bits: int) -> Column:
    return value.bitwiseXOR(F.shiftrightunsigned(value, bits))


def _stir(value: Column) -> Column:
    return _word(_rotate(value, 13) * F.lit(5) + F.lit(STEP_ADD))


def murmur3_long(value) -> Column:
    """Hash of a BIGINT (little-endian, seed 0) as one expression, below 2**32.

    The tree is wide because every step names its input twice; Spark shares the common
    parts at run time. :func:`with_bucket` plans faster and is what the writers use.
    """
    value = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    low = _times(_rotate(_times(_word(value), C1), 15), C2)
    high = _times(_rotate(_times(F.shiftrightunsigned(value, 32), C1), 15), C2)
    state = _stir(_stir(low).bitwiseXOR(high)).bitwiseXOR(F.lit(8))
    state = _times(_fold(state, 16), FINAL_1)
    state = _times(_fold(state, 13), FINAL_2)
    return _fold(state, 16)


def bucket_id(value, buckets: int) -> Column:
    """``bucket(id, N)``: hash with the sign bit cleared, modulo ``buckets``."""
    check_buckets(buckets)
    return _bucket_of(murmur3_long(value), buckets)


def _bucket_of(hashed: Column, buckets: int) -> Column:
    return (hashed.bitwiseAND(F.lit(0x7FFFFFFF)) % F.lit(buckets)).cast("int")


def check_buckets(buckets: int) -> None:
    if buckets < 1:
        raise ValueError(f"bucket count must be positive, got {buckets}")


def with_bucket(df: DataFrame, key: str, buckets: int, out: str = "id_bucket") -> DataFrame:
    """Add ``out = bucket(key, buckets)``, binding every hash step to a column of its own.

    The last step goes through ``explode`` of a one-element array: the optimizer moves filters
    below projections by substitution, which would undo the binding, but never below that.
    """
    check_buckets(buckets)
    names = df.columns
    lo, hi = "__bucket_lo", "__bucket_hi"
    a, b, id_ = F.col(lo), F.col(hi), F.col(key).cast("bigint")
    rounds = (
        {lo: _times(_word(id_), C1), hi: _times(F.shiftrightunsigned(id_, 32), C1)},
        {lo: _rotate(a, 15), hi: _rotate(b, 15)},
        {lo: _times(a, C2), hi: _times(b, C2)},
        {lo: _stir(a)},
        {lo: _stir(a.bitwiseXOR(b)).bitwiseXOR(F.lit(8))},
        {lo: _fold(a, 16)},
        {lo: _times(a, FINAL_1)},
        {lo: _fold(a, 13)},
        {lo: _times(a, FINAL_2)},
    )
    for columns in rounds:
        df = df.withColumns(columns)
    bucket = F.explode(F.array(_bucket_of(_fold(a, 16), buckets))).alias(out)
    return df.select(*[n for n in names if n != out], bucket)
