"""Sessions by New York and exchange time, and the levels and masks that depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import new_york
from .windows import by_symbol

# Named zones, in minutes of the New York day.
KILL_ZONES = (
    ("London Open", 120, 300), ("Pre-NY", 300, 420), ("NY Open", 420, 600), ("London Close", 600, 720),
    ("Afternoon NY", 780, 900), ("Early Sydney", 1020, 1140), ("Sydney Open", 1140, 1260), ("Asian Midnight", 0, 120),
)


def ny_minute(ts: Column) -> Column:
    """Minute of the New York day of a UTC time."""
    t = new_york(ts)
    return F.hour(t) * 60 + F.minute(t)


def ny_date(ts: Column) -> Column:
    return F.to_date(new_york(ts))


def kill_zone(ts: Column) -> Column:
    """Name of the zone a UTC time falls in, or null."""
    m = ny_minute(ts)
    return F.coalesce(*(F.when((m >= a) & (m < b), name) for name, a, b in KILL_ZONES))


def market_open(ts: Column) -> Column:
    """Exchange hours in UTC: Sunday 22:00 to Friday 21:00, closed daily from 21:00 to 22:00."""
    day, h = F.weekday(ts), F.hour(ts)
    return F.when(day == 5, False).when(day == 6, h >= 22).when(day == 4, h < 21).otherwise(h != 21)


def regular_vwap(bars: DataFrame, start: int = 570, end: int = 960, least: int = 2) -> DataFrame:
    """Adds vwap, running over the regular session of the New York day; null outside it and before `least` bars."""
    inside = (F.col("_m") >= start) & (F.col("_m") < end)
    b = bars.withColumns({"_m": ny_minute(F.col("ts")), "_d": ny_date(F.col("ts"))})
    w = Window.partitionBy("symbol", "_d").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    on = lambda c: F.sum(F.when(inside, c)).over(w)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    vwap = on(tp * F.col("volume")) / F.nullif(on(F.col("volume")), F.lit(0))
    return b.withColumn("vwap", F.when(inside & (F.count(F.when(inside, 1)).over(w) >= least), vwap)).drop("_m", "_d")


def trading_day_vwap(bars: DataFrame, hours: int = 2) -> DataFrame:
    """Adds vwap, running over the trading day that begins `hours` before midnight UTC; a bar without volume weighs one."""
    w = Window.partitionBy("symbol", F.to_date(F.col("ts") + F.expr(f"INTERVAL {hours} HOURS"))).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    tp, v = (F.col("high") + F.col("low") + F.col("close")) / 3, F.greatest(F.col("volume").cast("double"), F.lit(1.0))
    return bars.withColumn("vwap", F.sum(tp * v).over(w) / F.sum(v).over(w))


def overnight_gap(bars: DataFrame, hours: int = 21) -> DataFrame:
    """Per symbol and session day (it begins at `hours` UTC): first open, last close, and the gap from the close before."""
    day = F.to_date(F.col("ts") - F.expr(f"INTERVAL {hours} HOURS"))
    d = bars.groupBy("symbol", day.alias("session_day")).agg(F.min_by("open", "ts").alias("first_open"),
        F.max_by("close", "ts").alias("last_close"))
    before = F.lag("last_close").over(Window.partitionBy("symbol").orderBy("session_day"))
    return d.withColumn("gap", F.col("first_open") - before)


def roll_gap_mask(bars: DataFrame, hours: int, smear: int) -> DataFrame:
    """Adds contaminated: one of the last `smear` bars follows a pause of more than `hours` that no Friday began."""
    w = by_symbol()
    before = F.lag("ts").over(w)
    gap = (F.col("ts") > before + F.expr(f"INTERVAL {hours} HOURS")) & (F.weekday(before) != 4)
    b = bars.withColumn("_g", F.coalesce(gap, F.lit(False)).cast("int"))
    return b.withColumn("contaminated", F.max("_g").over(w.rowsBetween(1 - smear, 0)) == 1).drop("_g")


def first_bar_of_hour(bars: DataFrame, hour: int) -> DataFrame:
    """The first bar at or after the hour, and inside it, of each symbol and day."""
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    return bars.where(F.hour("ts") == hour).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def turn_of_month(bars: DataFrame, days: int) -> DataFrame:
    """Adds turn: "first" or "last" where the day is among that many trading days of its month, else null."""
    d = bars.select("symbol", F.to_date("ts").alias("_day")).distinct()
    w = Window.partitionBy("symbol", F.trunc("_day", "month"))
    n = lambda c: F.row_number().over(w.orderBy(c))
    d = d.withColumn("turn", F.when(n(F.asc("_day")) <= days, "first").when(n(F.desc("_day")) <= days, "last"))
    return bars.withColumn("_day", F.to_date("ts")).join(d, ["symbol", "_day"]).drop("_day")
