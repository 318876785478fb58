"""Queries of streams against their SQL where times have fractions of a millisecond."""

import datetime as dt

import duckdb
import pytest

from strandloom.plans import catalog


@pytest.mark.parametrize("name", ["q_stream_sliding", "q_stream_keep_best", "q_stream_timers"])
def test_last_half_millisecond_belongs_to_the_next_window(spark, tmp_path, name):
    day = dt.datetime(2024, 1, 2)
    before = [dt.timedelta(microseconds=m) for m in (400, 500, 501, 1500)]
    times = [day - b for b in before] + [day + dt.timedelta(hours=5) - b for b in before] + [day + dt.timedelta(hours=h) for h in (-7, 3, 60)]
    rows = [(i, t, i % 2, "view", float(i % 3), "{}") for i, t in enumerate(times)]
    (tmp_path / "events.parquet").mkdir()
    db = duckdb.connect()
    db.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    db.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    db.execute(f"COPY events TO '{tmp_path}/events.parquet/part-0.parquet' (FORMAT parquet)")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
