"""Every query against its SQL, and the shape of the plans behind them."""

import pytest

from checks.compare import connect, mismatch
from checks.oracles import ORACLES
from checks.queries import QUERIES
from conftest import SMALL
from starqa.plans import questions
from starqa.sources.warehouse import orders_store


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert mismatch(spark, SMALL, name, duck)[0] is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_year_reaches_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(questions.total_revenue_in_year(orders_store(spark, SMALL), 1996))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in text
    assert "LessThan(o_orderdate,1997-01-01" in text


def test_scans_read_only_what_is_asked(spark):
    text = plan(questions.top_customers(orders_store(spark, SMALL)))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in text


@pytest.mark.parametrize("name", ["q4_top_customers", "q8_revenue_increase", "q9_no_sales", "j1_sales"])
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
