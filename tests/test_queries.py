"""Every registered query with SQL agrees with DuckDB on the small tables; the others run and keep their schema."""

import pytest
from against_duckdb import difference

from lakeloom.plans.registered import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0
