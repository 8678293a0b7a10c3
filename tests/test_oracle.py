"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from checks.compare import difference
from checks.queries import ORACLE, QUERIES
from tests.conftest import SMALL


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    result = QUERIES[name](spark, SMALL).toPandas()
    assert difference(result, con.execute(ORACLE[name]).fetchdf()) is None


def test_entry_gives_rows_with_a_stable_schema(spark):
    frame = entry_point.entry(spark)
    assert frame.columns == ["run_id", "bin_idx", "time_sec", "pair_idx", "location", "band", "power"]
    assert frame.count() > 0
