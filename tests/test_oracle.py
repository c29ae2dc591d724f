"""Every registered relational query against its SQL, on the smallest tables."""

import os

import pytest

import oracle
from cellgrid.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, catalog.QUERIES[name], catalog.SQL[name], SF) is None


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_frozen_digest_ignores_order(spark):
    from pyspark.sql import functions as F

    from cellgrid.operators.graph import frozen

    a = spark.range(100).withColumn("x", F.col("id") % 7)
    assert frozen(a).collect() == frozen(a.orderBy(F.desc("id"))).collect()
    assert frozen(a).collect() != frozen(a.filter("id > 0")).collect()
