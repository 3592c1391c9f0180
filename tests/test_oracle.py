"""Every registered query with an oracle equals DuckDB on the driver's tables."""
import pytest

from __spark_entry__ import oracle_sql, queries
from tests.conftest import SF_SMALL
from tests import oracle_harness
from tests.oracle_harness import compare

oracle_harness.STRICT = True     # doubles must be bit-identical, not just close

ORACLE = sorted(oracle_sql())


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_duckdb(spark, name):
    ok, msg = compare(spark, name, SF_SMALL, queries(), oracle_sql())
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert "risk_percentile" in df.columns
