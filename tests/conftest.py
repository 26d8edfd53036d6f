import datetime as dt
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from panelark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g", "panelark-tests")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Make small groups count as hot, so that the split paths run."""
    settings = {
        "spark.panelark.skew.smallInputBytes": "0",
        "spark.panelark.skew.minRows": "60",
        "spark.panelark.skew.sliceRows": "100",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key in settings:
        spark.conf.unset(key)


def bars_rows(days=120, symbols=("A", "B", "C"), seed=7):
    """Random-walk bars, one row per calendar day."""
    import random

    rng = random.Random(seed)
    rows = []
    for symbol in symbols:
        close = 100.0
        for day in range(days):
            open_ = close * (1 + rng.gauss(0, 0.005))
            close = open_ * (1 + rng.gauss(0, 0.02))
            high, low = max(open_, close) * 1.01, min(open_, close) * 0.99
            mood = rng.uniform(-0.5, 0.5)
            stamp = dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
            rows.append((stamp, symbol, open_, high, low, close, float(rng.randint(500, 5000)), mood))
    return rows


BAR_SCHEMA = (
    "timestamp timestamp_ntz, symbol string, open double, high double, low double, close double, volume double, "
    "sentiment double"
)


@pytest.fixture
def make_bars(spark):
    def make(days=120, symbols=("A", "B", "C"), seed=7):
        return spark.createDataFrame(bars_rows(days, symbols, seed), BAR_SCHEMA)

    return make
