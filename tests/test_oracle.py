"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    mine = entry.queries()[name](spark, SF).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert mine.num_rows > 0
    else:
        assert oracle.differences(mine, con.execute(sql).to_arrow_table()) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
