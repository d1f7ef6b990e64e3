import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from tests.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a DataFrame from rows whose 'ts' values are text."""

    def build(rows, schema):
        text = schema.replace("TIMESTAMP_NTZ", "STRING")
        df = spark.createDataFrame(rows, text)
        for field in schema.split(","):
            name, dtype = field.split()
            if dtype == "TIMESTAMP_NTZ":
                df = df.withColumn(name, df[name].cast("timestamp_ntz"))
        return df

    return build


@pytest.fixture
def hourly(spark):
    """n consecutive hours from a start, with values from a function of the hour number."""
    import datetime as dt

    def build(values, series="a", start="2024-01-01 00:00:00", step_hours=1):
        first = dt.datetime.fromisoformat(start)
        rows = [
            (series, first + dt.timedelta(hours=i * step_hours), v)
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, "series STRING, ts TIMESTAMP_NTZ, value DOUBLE")

    return build
