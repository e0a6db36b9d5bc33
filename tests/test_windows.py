"""Event-time sessions over files that come late, twice and out of order."""

import datetime as dt

from rankloom.streaming import sessions, windows

SCHEMA = "event_id long, user_id long, ts timestamp, value double"
START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def run(spark, folder, n, rows, make, out):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n}")
    source = sessions.turn_source(spark, f"{folder}/in/*", SCHEMA)
    return windows.drained(make(source), f"{folder}/{out}")


def test_sessions_merge_close_and_count_what_is_late(spark, tmp_path):
    def of(n, *rows):
        found, late = run(spark, tmp_path, n, rows, windows.session_windows, "sessions")
        return {(r["user_id"], r["started"].replace(tzinfo=dt.UTC), r["n"], r["total"]) for r in found.collect()}, late

    assert of(0, (1, 1, at(0), 1.0), (2, 1, at(40), 2.0), (3, 2, at(5), 4.0)) == (set(), 0)
    # an event between two runs makes them one; nothing has closed yet
    assert of(1, (4, 1, at(20), 8.0), (5, 1, at(90), 16.0)) == (set(), 0)
    closed, late = of(2, (6, 2, at(400), 32.0))
    assert closed == {(1, at(0), 3, 11.0), (1, at(90), 1, 16.0), (2, at(5), 1, 4.0)} and late == 0
    again, late = of(3, (7, 1, at(100), 64.0), (8, 2, at(410), 128.0))
    assert again == closed and late == 1  # later than the watermark: counted, and no session changes


def test_rows_that_arrive_twice_count_once(spark, tmp_path):
    def of(n, *rows):
        found, late = run(spark, tmp_path, n, rows, windows.once, "once")
        return sorted(r["event_id"] for r in found.collect()), late

    assert of(0, (1, 1, at(0), 1.0), (1, 1, at(0), 1.0), (2, 1, at(3), 1.0)) == ([1, 2], 0)
    assert of(1, (2, 1, at(3), 1.0), (3, 1, at(9), 1.0)) == ([1, 2, 3], 0)
    assert of(2, (4, 1, at(500), 1.0))[0] == [1, 2, 3, 4]
    assert of(3, (5, 1, at(10), 1.0), (6, 1, at(501), 1.0)) == ([1, 2, 3, 4, 6], 1)
