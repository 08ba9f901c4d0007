"""Every registered query against its oracle SQL (DuckDB) on sf0.001."""

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    fn = E.queries()[name]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, SF).count() >= 0
        return
    _, problems = compare(spark, con, fn, sql, SF)
    assert not problems, problems


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 3
    assert df.columns == ["rule_index", "expression", "total_registries", "passed_rule", "total_wrong_lines"]
