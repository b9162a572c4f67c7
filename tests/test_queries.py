"""Every registered query with SQL gives the same rows as DuckDB over the smallest tables; the others give rows."""

import pytest

from krylake.plans import catalogue
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want, cols = duck.execute(catalogue.ORACLES[name]).df(), sorted(got.columns)
    assert sorted(want.columns) == cols
    a, b = (d[cols].astype(str).sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert a.equals(b)
