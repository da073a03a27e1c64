"""Stop monitor and circuit breaker over several batches, by numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwright.streaming import jobs, monitors

DAY = dt.datetime(2024, 1, 2)
SCHEMA = "event_id int, ts timestamp, symbol string, price double"


def stream(spark, tmp_path, ticks, batches):
    """Ticks (minute of the day in UTC, symbol, price) as files in the order of time, one a batch."""
    src = str(tmp_path / f"in{batches}")
    step = -(-len(ticks) // batches)
    for i in range(0, len(ticks), step):
        rows = [(i + j, DAY + dt.timedelta(minutes=m), s, float(p)) for j, (m, s, p) in enumerate(ticks[i:i + step])]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    return jobs.stream_ticks(spark, src, spark.read.parquet(src).schema, 1)


LIMITS = {"stop_loss_pct": 0.10, "trailing_stop_pct": 0.05, "flatten_minute": 945}
#: The flatten minute of the session, 15:45, is 19:45 UTC.
FLAT = 945 + 240


def events(spark, tmp_path, ticks, positions, batches, limits=LIMITS):
    pos = spark.createDataFrame([(a, s, float(e), DAY + dt.timedelta(minutes=m)) for a, s, e, m in positions], "account long, symbol string, entry double, since timestamp")
    bars = monitors.minute_bars(stream(spark, tmp_path, ticks, batches))
    out = jobs.drain(monitors.stream_stops(bars, pos, "day", limits), spark, "t-stops", keyed=True).collect()
    return sorted((r.account, r.symbol, int((r.ts - DAY).total_seconds() // 60), r.kind, r.price, r.high) for r in out)


@pytest.mark.parametrize("batches", [1, 5])
def test_stops_warnings_and_flatten(spark, tmp_path, batches):
    a = [(600, "A", 100), (601, "A", 120), (602, "A", 115.1), (603, "A", 113.9), (604, "A", 90)]
    b = [(700, "B", 50), (701, "B", 48.9)]
    late = [(FLAT + 60, "Z", 1), (FLAT + 120, "Z", 1)]
    positions = [
        (1, "A", 100.0, 590),   # trails from 120: near at 115.1, out at 113.9
        (2, "A", 127.0, 601),   # enters high: near its hard stop at 115.1, out at 113.9 by the hard stop, which comes first
        (3, "A", 100.0, 603),   # opened later: its high is 113.9, so 90 is a hard stop
        (1, "B", 50.0, 690),    # falls 2.2 %: flattened by the timer, no tick comes then
        (4, "C", 10.0, 690),    # its symbol never trades: flattened without a price
        (5, "B", 50.0, FLAT + 1),  # opened after the flatten minute: waits for the next day's
        (6, "A", 0.0, 590),     # no entry, no position
    ]
    want = [
        (1, "A", 602, "near_trailing_stop", 115.1, 120.0), (1, "A", 603, "trailing_stop", 113.9, 120.0),
        (1, "B", FLAT, "eod_flatten", 48.9, 50.0),
        (2, "A", 602, "near_hard_stop", 115.1, 120.0), (2, "A", 602, "near_trailing_stop", 115.1, 120.0), (2, "A", 603, "hard_stop", 113.9, 120.0),
        (3, "A", 604, "hard_stop", 90.0, 113.9),
        (4, "C", FLAT, "eod_flatten", None, None),
    ]
    assert events(spark, tmp_path, a + b + late, positions, batches) == sorted(want)


def test_a_bar_past_the_flatten_minute_reports_what_the_timer_would(spark, tmp_path):
    ticks = [(600, "A", 100), (FLAT + 5, "A", 60), (FLAT + 90, "A", 70)]
    assert events(spark, tmp_path, ticks, [(1, "A", 100.0, 590)], 1) == [(1, "A", FLAT, "eod_flatten", 100.0, 100.0)]


def test_no_flatten_and_a_new_session_resets_the_high(spark, tmp_path):
    ticks = [(600, "A", 100), (600 + 1440, "A", 96), (601 + 1440, "A", 94), (700 + 1440, "A", 94)]
    got = events(spark, tmp_path, ticks, [(1, "A", 100.0, 590)], 2, {**LIMITS, "flatten_minute": None})
    assert got == []


@pytest.mark.parametrize("batches", [1, 4])
def test_breaker_trips_once_a_day(spark, tmp_path, batches):
    ticks = [(600, "A", 100), (600, "A", 99), (601, "A", 96), (602, "A", 90), (603, "A", 120), (604, "A", 80), (1440, "A", 80), (1441, "A", 77.6), (1442, "A", 70), (1500, "B", 5), (1600, "B", 5)]
    eq = stream(spark, tmp_path, ticks, batches).select("event_id", "ts", F.col("symbol").alias("account"), F.col("price").alias("equity"))
    got = jobs.drain(monitors.stream_breaker(monitors.minute_equity(eq), limit=0.03), spark, "t-break", keyed=True).collect()
    assert sorted((r.account, int((r.ts - DAY).total_seconds() // 60), r.equity, round(r.loss_pct, 6)) for r in got) == [("A", 601, 96.0, -0.04), ("A", 1441, 77.6, -0.03)]
