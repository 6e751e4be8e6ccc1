import pytest

from framesift.plans import evidence, results  # noqa: F401  these register more
from framesift.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import rows_of, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, name):
    got = rows_of(QUERIES[name], spark, SF)
    if name in ORACLE_SQL:
        assert got == sql_rows(ORACLE_SQL[name], SF)
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
