import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from isotherm.schema import OBSERVATION  # noqa: E402
from isotherm.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 2)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def obs(spark):
    """obs([(date, {column: value}), ...], station=1): observations with missing columns NULL."""
    names = [f.name for f in OBSERVATION.fields]

    def make(rows, station=1):
        data = []
        for date, values in rows:
            full = {"station": station, "datum": date, "qn": 10, "qn3": 10, "quelle": 0, **values}
            data.append(tuple(full.get(n) for n in names))
        return spark.createDataFrame(data, OBSERVATION)

    return make


def days(first, last, value):
    """value(date) -> dict of columns, or None to leave the day out."""
    out, d = [], first
    while d <= last:
        v = value(d)
        if v is not None:
            out.append((d, v))
        d += dt.timedelta(days=1)
    return out


def temps(mean, spread=5.0):
    return {"tmk": float(mean), "txk": float(mean + spread), "tnk": float(mean - spread)}
