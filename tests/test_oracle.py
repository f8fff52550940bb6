"""Every registered query against its DuckDB oracle (row count, columns, values)."""

import math

import pytest

import __spark_entry__ as E
from frameprep.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, float):
        return (1, repr(v))
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    return (1, str(v))


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2
    assert df.columns[0] == "column_name"


def test_every_query_is_registered_with_a_callable():
    assert len(QUERIES) >= 60
    assert set(ORACLE) <= set(QUERIES) <= set(E.queries())
    assert set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    duck.execute(f"CREATE OR REPLACE TEMP VIEW wanted AS {ORACLE[name]}")  # the driver wraps oracles in a view too
    rel = duck.execute("SELECT * FROM wanted")
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    srows = sdf.collect()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    cols = sorted(ocols)
    s = sorted(tuple(_norm(r[c]) for c in cols) for r in srows)
    o = sorted(tuple(_norm(dict(zip(ocols, r))[c]) for c in cols) for r in orows)
    assert s == o


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0
