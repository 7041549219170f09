"""Sessions by New York and exchange time, on the days the clocks change too."""

import datetime as dt

from pyspark.sql import functions as F

from tapestride.operators import bars, sessions, windows

AT = "%Y-%m-%d %H:%M"


def times(spark, *texts):
    return spark.createDataFrame([(k, dt.datetime.strptime(t, AT)) for k, t in enumerate(texts)], "k int, ts timestamp_ntz")


def test_zones_over_clock_changes(spark):
    # summer time began on 2024-03-10 at 07:00 UTC and ended on 2024-11-03 at 06:00 UTC
    t = times(spark, "2024-03-08 07:30", "2024-03-10 06:30", "2024-03-10 07:30", "2024-03-11 06:30", "2024-11-01 06:30", "2024-11-04 06:30", "2024-11-04 17:30")
    got = t.select("k", sessions.kill_zone(F.col("ts")).alias("z"), sessions.ny_minute(F.col("ts")).alias("m")).orderBy("k").collect()
    assert [(r.m, r.z) for r in got] == [
        (150, "London Open"), (90, "Asian Midnight"), (210, "London Open"), (150, "London Open"), (150, "London Open"), (90, "Asian Midnight"), (750, None),
    ]


def test_exchange_hours(spark):
    t = times(spark, "2024-01-05 20:59", "2024-01-05 21:00", "2024-01-06 12:00", "2024-01-07 21:59", "2024-01-07 22:00", "2024-01-08 21:30", "2024-01-08 22:00")
    got = [r.o for r in t.select("k", sessions.market_open(F.col("ts")).alias("o")).orderBy("k").collect()]
    assert got == [True, False, False, False, True, False, True]


def test_widths_and_turns(spark):
    rows = [("a", dt.datetime(2024, 1, 31, 23, 52) + dt.timedelta(minutes=7 * k), k, 10.0 + k, 1) for k in range(6)]
    tape = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, px double, size long")
    five = bars.time_bars(tape, "5 minutes").orderBy("ts").collect()
    assert [(r.ts.strftime("%H:%M"), r.open, r.close) for r in five] == [("23:50", 10.0, 10.0), ("23:55", 11.0, 11.0), ("00:05", 12.0, 12.0), ("00:10", 13.0, 13.0), ("00:20", 14.0, 14.0), ("00:25", 15.0, 15.0)]
    assert [(r.ts.strftime("%d %H:%M"), r.n_ticks) for r in bars.time_bars(tape, "4 hours").orderBy("ts").collect()] == [("31 20:00", 2), ("01 00:00", 4)]
    b = bars.with_bar_id(bars.time_bars(tape, "5 minutes"))
    assert {(r.ts.day, r.turn) for r in sessions.turn_of_month(b, 1).collect()} == {(31, "first"), (1, "first")}


def test_open_gaps_by_hand(spark):
    rows = [(10, 9), (11, 10), (14, 12), (15, 13), (13, 9.5), (9, 8), (6, 5)]  # up gap 10-12 at bar 3, filled at bar 5; down gap 9.5-6 at bar 7
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), k + 1, float(h), float(lo)) for k, (h, lo) in enumerate(rows)], "symbol string, ts timestamp, bar_id int, high double, low double")
    got = {r.bar_id: (r.gap_floor, r.gap_ceiling) for r in windows.open_gaps(df, 10).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (10.0, None), 4: (11.0, None), 5: (None, None), 6: (None, 13.0), 7: (None, 9.5)}
    short = {r.bar_id: r.gap_floor for r in windows.open_gaps(df, 1).collect()}
    assert short[3] == 10.0 and short[4] == 11.0  # a gap lives on its own bar only
