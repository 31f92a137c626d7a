"""Every query on the smallest tables, beside its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from wardgraph.suite.compare import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        problems, _ = differences(df, con, ORACLE[name])
        assert not problems
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_id", "hadm_id", "subject_id", "bundles", "labs", "abnormal", "first_charttime"]
    assert df.count() > 0
