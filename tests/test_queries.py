import pytest

from tessella.queries import ORACLES, QUERIES

from .compare import duck, rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    columns, want = duck(ORACLES[name], SF)
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want)
