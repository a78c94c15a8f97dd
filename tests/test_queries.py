"""The registry and a sample of its queries against their SQL at the smallest scale."""

from __future__ import annotations

import os

import pytest

from conftest import SF

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry_points  # noqa: E402
from check_queries import TABLES, rows_of  # noqa: E402
from tickloom.catalog import load  # noqa: E402

SAMPLE = (
    "signal_mix", "trend_slope", "bars_normalized", "barrier_outcomes", "performance_summary", "run_insights", "error_health",
    "grid_rank", "session_gaps", "stream_bars", "raw_csv_roundtrip", "response_parse", "contract_validation", "timestamp_parse",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_registry_is_consistent():
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 130
    own = load()
    assert set(own) <= set(queries) and {name for name, (_, sql) in own.items() if sql is None} == {"feature_frame"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    got = entry_points.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_statistics_cover_every_feature(spark):
    from tickloom.catalog import statistics
    from tickloom.operators.features import feature_names
    from tickloom.operators.features.families import FAMILIES

    assert statistics.FAMILY_OF == {c: family for family in FAMILIES for c in feature_names(families=[family])}
    assert set(statistics.COLUMNS) == set(feature_names())
    for name in ("nan_inf_counts_all", "variance_topk_all", "corr_pairs_all", "zscore_outliers_all"):
        test_query_matches_sql(spark, name)
    assert entry_points.queries()["variance_topk_all"](spark, SF).count() == 10
