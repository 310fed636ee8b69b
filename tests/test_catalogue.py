import pytest

import __spark_entry__
from noticeflow import catalogue

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, con, sf, name):
    assert same(spark, con, sf, catalogue.queries()[name], catalogue.oracle_sql()[name]) >= 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["source", "source_id", "kind"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf, capsys):
    catalogue.upsert_unmatched(spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    catalogue.survey_diff(spark, sf).explain("formatted")
    assert "CartesianProduct" not in (plan := capsys.readouterr().out) and "BroadcastNestedLoopJoin" not in plan
