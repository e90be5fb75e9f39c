import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wakeline.workspace import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


AS_OF = "2024-06-01 12:00:00"
T = datetime(2024, 6, 1, 12, tzinfo=timezone.utc)

POSITIONS = "position_id long, mmsi long, reported_at timestamp, received_at timestamp, source string, lon double, lat double, sog float, cog float, heading short, nav_status short, raw_id long"


@pytest.fixture(scope="session")
def at():
    """Time a number of minutes before the evaluation time."""
    return lambda minutes: T - timedelta(minutes=minutes)


@pytest.fixture(scope="session")
def fixes(spark, at):
    """Positions from (mmsi, minutes before T, lon, lat, sog[, cog, heading])."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            m, ago, lon, lat, sog, cog, heading = (*r, None, None)[:7]
            t = at(ago) if ago is not None else None
            full.append((i + 1, m, t, t, "feed", lon, lat, sog, cog, heading, None, None))
        return spark.createDataFrame(full, POSITIONS)

    return make


def box(x0, y0, x1, y1):
    return '{"type":"Polygon","coordinates":[[[%f,%f],[%f,%f],[%f,%f],[%f,%f],[%f,%f]]]}' % (x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)


@pytest.fixture(scope="session")
def square():
    return box


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
