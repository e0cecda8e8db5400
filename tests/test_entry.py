import os

import pytest

import __spark_entry__ as entry_point

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry(spark):
    rows = entry_point.entry(spark)
    assert rows.columns == ["page_id", "key", "scripts", "visible", "wall", "reason"] and rows.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
