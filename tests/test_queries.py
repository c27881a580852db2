"""Every registered query against its SQL, and the driver contract."""

import oracle
import pytest

import __spark_entry__ as entry
from brightrow.suite import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, folder, name):
    verdict, _ = oracle.compare(spark, duck, name, folder)
    assert verdict.startswith("same" if name in SQL else "rows only"), verdict


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert flagship.columns == ["event_type", "ts", "value", "k"]
    assert flagship.count() > 0
