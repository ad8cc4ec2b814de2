"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from oracle import compare, connect
from workload import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not available")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, db, name):
    ok, text = compare(QUERIES[name](spark, FOLDER), db, ORACLE[name])
    assert ok, text


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE and n not in ("admission", "effective_dimensions")])
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_mixed_frequency_with_closes_of_zero(spark, tmp_path):
    """The SQL's ln(0) is minus infinity."""
    folder, db = str(tmp_path), duckdb.connect()
    rows = f"SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS value) FROM '{FOLDER}/events.parquet'"
    db.execute(f"COPY ({rows}) TO '{folder}/events.parquet'")
    db.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    assert db.execute(f"SELECT count(*) FROM ({ORACLE['mixed_frequency']}) WHERE isinf(gap)").fetchone()[0] > 5
    ok, text = compare(QUERIES["mixed_frequency"](spark, folder), db, ORACLE["mixed_frequency"])
    assert ok, text


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
