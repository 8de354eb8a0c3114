"""Small column helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def positions_to(last: Column) -> Column:
    """0 … ``last``; empty when ``last`` is negative."""
    none = F.array().cast("array<int>")
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(none)


def row_key(df: DataFrame) -> Column:
    """A 128-bit digest of all columns: rows with the same key are alike in every column."""
    parts = [F.coalesce(F.concat(F.lit("="), col(c).cast("string")), F.lit("0")) for c in df.columns]
    marked = [F.concat(F.length(part).cast("string"), part) for part in parts]
    return F.unhex(F.md5(F.concat(*marked).cast("binary")))
