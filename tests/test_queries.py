"""Each query of the star schema against DuckDB, or for rows where SQL can't express it."""

import pytest

from tests.compare import SF, difference, tables
from tidemark import queries as own


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", own.queries())
def test_query(spark, con, name):
    df = own.queries()[name](spark, SF)
    if name in own.oracle_sql():
        assert difference(df, con, own.oracle_sql()[name]) is None
    else:
        rows = df.collect()  # with all columns, so that all models run; what the rows hold is tested by itself: see the README
        assert df.columns and rows


def test_flagship(spark):
    assert own.flagship(spark, SF).count() > 0
