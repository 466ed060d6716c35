import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from panelcast.session import local_session

    session = local_session("*", shuffle_partitions=8, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """panel(rows, measures) -> DataFrame of (station, ts, measures) from tuples with text times."""

    def build(rows, measures=("m1",)):
        schema = "station string, ts string, " + ", ".join(f"{m} double" for m in measures)
        df = spark.createDataFrame(rows, schema)
        return df.withColumn("ts", df.ts.cast("timestamp_ntz"))

    return build


@pytest.fixture(scope="session")
def synthetic(spark):
    """Three stations, sixty whole days of hours: daily season, weekly season, trend, noise by hash."""
    return spark.sql(
        """
        SELECT s.station, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, h.id) AS ts,
               s.level + 0.005 * h.id + 8 * sin(2 * pi() * (h.id % 24) / 24)
                 + 3 * sin(2 * pi() * h.id / 168) + (pmod(hash(s.station, h.id), 100) - 50) / 50.0 AS m1,
               s.level * 2.0 + 5 * cos(2 * pi() * (h.id % 24) / 24) AS m2
        FROM (VALUES ('a', 30.0D), ('b', 45.0D), ('c', 60.0D)) s(station, level)
        LATERAL VIEW explode(sequence(0, 60 * 24 - 1)) h AS id
        """
    )
