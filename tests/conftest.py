import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from tickwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        }
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture
def bars(spark):
    """Builds a bar frame from closes per symbol, one business day apart."""
    import datetime as dt

    def build(series, **cols):
        rows = []
        for symbol, closes in series.items():
            for i, c in enumerate(closes):
                day = dt.date(2020, 1, 1) + dt.timedelta(days=i)
                hi = cols["high"][i] if "high" in cols else c
                lo = cols["low"][i] if "low" in cols else c
                op = cols["open"][i] if "open" in cols else c
                rows.append((symbol, day, *map(float, (op, hi, lo, c)), 100.0))
        schema = "symbol string, date date, open double, high double, low double, close double, volume double"
        return spark.createDataFrame(rows, schema)

    return build
