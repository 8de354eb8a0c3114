"""Run registered queries beside their SQL and compare: ``python tests/oracle.py [sf] [name…]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark and DuckDB names of the types the queries return.
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(rows, order):
    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def differences(frame, con, sql: str) -> list[str]:
    """Reasons why the frame and the SQL disagree (none = equal)."""
    rows = [tuple(r) for r in frame.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    out = []
    if sorted(frame.columns) != sorted(names):
        return [f"columns {sorted(frame.columns)} vs {sorted(names)}"]
    for name, kind in frame.dtypes:
        if SAME_TYPE.get(kind) != types[name]:
            out.append(f"type of {name}: {kind} vs {types[name]}")
    if len(rows) != len(expected):
        out.append(f"rows {len(rows)} vs {len(expected)}")
    mine = canonical(rows, [frame.columns.index(n) for n in sorted(names)])
    theirs = canonical(expected, [names.index(n) for n in sorted(names)])
    if mine != theirs:
        extra = [r for r in mine if r not in set(theirs)][:2]
        missing = [r for r in theirs if r not in set(mine)][:2]
        out.append(f"values differ: only here {extra}, only there {missing}")
    return out


def main() -> int:
    from conftest import make_session

    from vectorloom.suite import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark, con = make_session(), connect(sf_dir)
    failed = 0
    for name in wanted:
        started = time.monotonic()
        try:
            frame = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problems = differences(frame, con, ORACLES[name])
                note = "equal" if not problems else "; ".join(problems)
            else:
                problems, note = [], f"{frame.count()} rows (no SQL)"
        except Exception as error:  # report and go on with the next query
            problems, note = [str(error)], f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:32s} {time.monotonic() - started:6.2f}s {note}", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
