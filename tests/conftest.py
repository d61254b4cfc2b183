import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "tidegrid-tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows plus a DDL schema; text moments become TIMESTAMP_NTZ."""
    def make(rows, schema):
        ntz = [c.split()[0] for c in schema.split(",") if c.strip().endswith("timestamp_ntz")]
        df = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string"))
        return df.withColumns({c: df[c].cast("timestamp_ntz") for c in ntz}) if ntz else df
    return make


@pytest.fixture
def minutes(frame):
    """A one-series grid: one row per step with the given values."""
    def make(values, step=1, start="2025-01-01 00:00:00", series="s"):
        import pandas as pd
        times = pd.date_range(start, periods=len(values), freq=f"{step}min")
        return frame([(series, str(t), None if v is None else float(v)) for t, v in zip(times, values)],
                     "series_id string, ts timestamp_ntz, x double")
    return make
