"""Registered queries against DuckDB on the smallest tables.

``TIDEGRID_ALL_QUERIES=1`` checks every query; by default one of each kind keeps the suite short.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entrypoint
from tidegrid.plans.catalog import QUERIES

SF = os.environ.get("TIDEGRID_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("e17_naive_forecasts_scored", "a1_interval_means", "p11_balances", "e2_rolling_min_fraction", "e13_episodes", "e14_capped_dwell",
          "j8_event_context", "j9_next_event_within", "a4_scope_rollup", "a6_column_profile", "a9_time_grid_audit", "a38_promotion_gate",
          "m3_ols_per_horizon", "h7_gated_mixture", "k7_fold_coverage", "b1_rolling_origin_assignment", "t3_diverse_top_k")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(pdf):
    clean = lambda v: None if v is None or v != v else (float(v) if not isinstance(v, str) else v)
    return sorted(([clean(v) for v in r] for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(set(entrypoint.oracle_sql()) & set(QUERIES)) if os.environ.get("TIDEGRID_ALL_QUERIES") else SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name].frame(spark, SF).toPandas(), duck.execute(QUERIES[name].oracle()).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_answers_the_flagship_question(spark, monkeypatch):
    monkeypatch.setenv("TIDEGRID_ENTRY_DIR", SF)
    out = entrypoint.entry(spark)
    assert {"model", "horizon_minutes", "mape"} <= set(out.columns) and out.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())
