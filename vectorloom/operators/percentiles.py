"""Exact percentiles with linear interpolation, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketch that sets the ranges: a position is off by less than one part in this many.
ACCURACY = 10_000
#: Half the width of a range around a wanted position, in the same parts.
MARGIN = 5


def percentile_table(
    df: DataFrame, group: list[str], value: str, percents: list[float], more: dict[str, str] | None = None
) -> DataFrame:
    """``(group…, p50, p95, …)``; position ``(n-1)*p/100`` between the neighbours in order.

    One way for every size, in two scans, without a sort of a whole group and without a write. A mergeable
    sketch per group sets a narrow value range around each wanted position. A second scan counts rows: outside
    of these ranges one count per gap, inside them one per value; the running sum of the counts gives every
    rank exactly. What is ordered is about one row in a thousand per wanted percentile (all of a group of at most
    :data:`ACCURACY` rows). Should a position ever lie outside its range, the query fails instead of giving
    another value. A NULL group is a group, and one without values has NULL percentiles.

    ``more`` adds aggregates of the first scan, name -> SQL with ``v`` for the value.
    """
    if not group:
        keyed = df.withColumn("__all", F.lit(0))
        return percentile_table(keyed, ["__all"], value, percents, more).drop("__all")
    width = MARGIN / ACCURACY
    cuts = [min(1.0, max(0.0, p / 100.0 + side * width)) for p in percents for side in (-1, 1)]
    names = [f"`{c}`" for c in group]
    keys, same = ", ".join(names), " AND ".join(f"a.{c} <=> b.{c}" for c in names)
    ranges = " OR ".join(f"v BETWEEN e[{i}] AND e[{i + 1}]" for i in range(0, len(cuts), 2))
    # A gap between ranges is named by the edge below it; the lowest gap has none.
    below = ", ".join(f"if(e[{i}] < v, e[{i}], NULL)" for i in range(len(cuts)))
    slots, columns = [], []
    for number, p in enumerate(percents):
        at = f"((n - 1) * {p / 100.0!r}D)"
        for side in ("floor", "ceil"):
            hit = f"last > {side}{at} AND last - c <= {side}{at}"
            slots.append(f"max(CASE WHEN {hit} THEN if(exact, at, raise_error('a percentile left its range')) END) AS {side}{number}")
        columns.append(f"floor{number} + (ceil{number} - floor{number}) * ({at} - floor{at}) AS `p{p:g}`")
    extra = "".join(f", {sql} AS `{name}`" for name, sql in (more or {}).items())
    kept = "".join(f", a.`{name}`" for name in more or {})
    # Values equal to an edge come before the gap above it.
    statement = f"""
    WITH given AS (SELECT {keys}, `{value}` AS v FROM {{df}}),
    a AS (
      SELECT {keys}, percentile_approx(v, array({", ".join(f"{c!r}D" for c in cuts)}), {ACCURACY}) AS e, count(v) AS n{extra}
      FROM given GROUP BY {keys}),
    placed AS (
      SELECT {", ".join(f"b.{c}" for c in names)}, v, n <= {ACCURACY} OR {ranges} AS exact, greatest({below}) AS edge
      FROM given b JOIN a ON {same} WHERE v IS NOT NULL),
    counts AS (
      SELECT {keys}, if(exact, v, edge) AS at, exact, count(*) AS c FROM placed GROUP BY {keys}, if(exact, v, edge), exact),
    ranked AS (
      SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY at NULLS FIRST, exact DESC ROWS UNBOUNDED PRECEDING) AS last,
             sum(c) OVER (PARTITION BY {keys}) AS n FROM counts),
    b AS (SELECT {keys}, {", ".join(slots)} FROM ranked GROUP BY {keys})
    SELECT {", ".join(f"a.{c}" for c in names)}{kept}, {", ".join(columns)} FROM a LEFT JOIN b ON {same}
    """
    return df.sparkSession.sql(statement, df=df)
