"""Times between two whole seconds or milliseconds, which the given tables seldom hold where it matters."""

import datetime

import duckdb
import pytest

from quaymark.plans import registry
from test_queries import plain

EPOCH = datetime.datetime(1970, 1, 1)
YEARS = 54 * 31_556_952_000_000  # a border of mean years, in microseconds


@pytest.fixture
def against_sql(spark, tmp_path):
    def check(name, micros):
        """Events of one user at some times, by the query and by its SQL."""
        rows = [(i, EPOCH + datetime.timedelta(microseconds=at), 1) for i, at in enumerate(micros)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        wanted = duck.execute(registry.ORACLE_SQL[name])
        columns = [c[0] for c in wanted.description]
        found = plain(registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())
        assert found == plain(wanted.fetchall())
        return found

    return check


def test_years_begin_at_the_nearest_second(against_sql):
    near = [0, 1, -1, 499_999, 500_000, 700_000, -499_999, -500_000, -500_001, -700_000, 1_500_000, -1_500_000]
    found = against_sql("date_parts", [border + x for border in (YEARS, -YEARS, 0, 31_556_952_000_000) for x in near])
    assert any("2024" in x for x in found) and any("2023" in x for x in found)


def test_delays_are_between_nearest_milliseconds(against_sql):
    steps = [39_700, 40_400, 40_600, 499, 500, 501, 999_400, 999_600, 1_000_400, 0, 1_499, 1_500, 123_456, 77_777, 500_500, 250_250]
    at, times = -3_000_000, []
    for step in steps * 4:
        times.append(at)
        at += step
    against_sql("frame_delays", times)
