"""Every query of the library beside its SQL, on the smallest tables."""

import pytest
from compare import spark_rows, sql_rows

from loomvec.plans import catalogue, more  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    names, rows = spark_rows(catalogue.QUERIES[name](spark, SMALL))
    sql_names, expected = sql_rows(catalogue.ORACLES[name], SMALL)
    assert names == sql_names
    assert len(rows) == len(expected)
    assert rows == expected
    assert rows or name == "registry_sound"
