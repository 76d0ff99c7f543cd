"""Every query against its oracle, and every other one for rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from qaloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose true answer at this scale may be empty.
MAY_BE_EMPTY = {"flt_by_metadata", "jn_anti_exclude", "p_push_list", "flt_scenario", "jn_semi_redundant", "jn_adjacent", "neg_adjacent", "flt_gate_simple"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) and v else "0" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    assert rows or name in MAY_BE_EMPTY
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert sorted(rows) == sorted(tuple(norm(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
