"""Every registered query that has SQL against DuckDB, and the others for rows."""

import oracle
import pytest

from tiergraph.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_label_filters_reach_the_scan(spark):
    plan = QUERIES["eql_seq_span"](spark, SF)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "EqualTo(label,A)" in plan and "CartesianProduct" not in plan


def test_a_label_filter_shuffles_nothing(spark):
    plan = QUERIES["eql_eq"](spark, SF)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan and "PartitionFilters: [isnotnull(level" in plan
