"""Every registered query of the library against DuckDB."""

from __future__ import annotations

import pytest
from compare import same_rows

from graphwright.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    same_rows(df, duck, ORACLE_SQL[name])
