"""Driver contract: entry() runs, and every registered query equals its DuckDB oracle."""

import duckdb
import pytest

import __spark_entry__ as E
from fleetlens.plans import catalog
from fleetlens import fixtures
from tools.compare_oracle import _rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in fixtures.BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["week_start", "week_end", "category", "total_duration_secs", "avg_gpu_utilization",
                          "max_gpu_utilization", "total_gpu_memory_mb", "event_count"]


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLES) == set(catalog.QUERIES) and set(catalog.QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols, orows = [d[0] for d in res.description], res.fetchall()
    assert sorted(scols) == sorted(ocols)
    assert _rows(scols, srows, False) == _rows(ocols, orows, False)
