"""Every core query with SQL agrees with it, on two sizes."""

import pytest
from oracle import differences

import __spark_entry__ as entry
from brindle.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_agrees_with_sql(spark, small, name):
    assert differences(spark, small, catalogue.QUERIES[name], catalogue.ORACLE[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() >= 0
