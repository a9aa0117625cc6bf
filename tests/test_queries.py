"""Every registered query against its SQL on the smallest scale."""

import pytest

import __spark_entry__ as entry
from check import compare, duck

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


def test_names():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert len(set(df.columns)) == len(df.columns)
        return
    cursor = duck(sf_dir).execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert compare(rows, df.columns, cursor.fetchall(), columns) is None
