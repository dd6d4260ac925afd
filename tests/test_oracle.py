"""Every registered query with an oracle agrees with DuckDB on the same parquet tables."""

import pytest

from pricelake.plans import check
from pricelake.plans.registry import oracle_sql, queries

from conftest import SF_ORACLE

SQL = oracle_sql()
QS = queries()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = check.compare(spark, SF_ORACLE, name, QS[name], SQL[name], con)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


@pytest.mark.parametrize("name", sorted(set(QS) - set(SQL)))
def test_query_without_oracle_runs(spark, name):
    df = QS[name](spark, SF_ORACLE)
    assert df.count() >= 0
