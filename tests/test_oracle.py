"""Every registered query against its SQL, on the smallest driver tables."""

import pytest
from oracle import connect, differences

from vectorloom.suite import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert differences(frame, con, ORACLES[name]) == []
    else:
        assert frame.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_index", "rk", "id", "dist"]
