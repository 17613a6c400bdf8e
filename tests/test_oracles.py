"""Every query that has SQL gives the rows of its SQL in DuckDB; the others run."""

from __future__ import annotations

import os
import sys

import pytest
from basalt import queries as Q

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import duck, rows_of  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, sf, name):
    df = Q.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name in Q.oracle_sql():
        cur = con.execute(Q.oracle_sql()[name])
        assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
