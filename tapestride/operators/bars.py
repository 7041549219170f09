"""Tapes to bars. Sums run per symbol and day, so a busy symbol is spread over its days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "id")


def ohlcv(tape: DataFrame, *keys: str) -> DataFrame:
    """OHLCV and count by keys; first and last by (ts, id). One partial aggregation, no sort."""
    at = F.struct(*ORDER)
    return tape.groupBy(*keys).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("n_ticks"),
    )


def time_bars(tape: DataFrame, unit: str = "hour") -> DataFrame:
    """Left-labelled, left-closed bars of a calendar unit ("hour") or of any width ("5 minutes"); empty ones don't exist."""
    start = F.window("ts", unit)["start"] if " " in unit else F.date_trunc(unit, "ts")
    t = tape.withColumn("bar_ts", start.cast("timestamp_ntz"))
    return ohlcv(t, "symbol", "bar_ts").withColumnRenamed("bar_ts", "ts")


def with_bar_id(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_id", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))


def clean(tape: DataFrame) -> DataFrame:
    """Trades with a price and a size; of equal (symbol, ts, px, size) the smallest id."""
    t = tape.where("size > 0 AND px > 0")
    return t.groupBy("symbol", "ts", "px", "size").agg(F.min("id").alias("id"))


def day() -> Column:
    return F.to_date("ts")


def tick_sign(tape: DataFrame, keys: tuple[str, ...] = ("symbol",), default: int = 1) -> DataFrame:
    """Adds sign: of the price change, inherited over unchanged prices, default before the first change."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    moved = F.signum(F.col("px") - F.lag("px").over(w)).cast("int")
    run = tape.withColumn("_m", F.when(moved != 0, moved))
    return run.withColumn("sign", F.coalesce(F.last("_m", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.lit(default))).drop("_m")


def quote_sign(tape: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds sign: -1 where the price falls, else +1; a tie is a buy."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    return tape.withColumn("sign", F.when(F.col("px") < F.lag("px").over(w), -1).otherwise(1))


def volume_bars(tape: DataFrame, size: int, big: int) -> DataFrame:
    """Event bars of `size` traded a symbol and day, with order flow; a tick belongs to the bar its first unit falls in."""
    keys = ("symbol", "day")
    t = tick_sign(tape.withColumn("day", day()), keys)
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    t = t.withColumn("bar", F.floor((F.sum("size").over(w) - F.col("size")) / size))
    bar = Window.partitionBy(*keys, "bar")
    t = t.withColumns({"_hi": F.max("px").over(bar), "_lo": F.min("px").over(bar)})
    at = F.struct(*ORDER)
    on = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0))
    out = t.groupBy(*keys, "bar").agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("n_ticks"),
        on(F.col("sign") > 0).alias("buyvol"), on(F.col("sign") < 0).alias("sellvol"), on(F.col("px") == F.col("_hi")).alias("highsz"),
            on(F.col("px") == F.col("_lo")).alias("lowsz"),
        F.round(on(F.col("size") >= big) / F.nullif(F.sum("size"), F.lit(0)), 6).alias("bigratio"),
    )
    run = Window.partitionBy(*keys).orderBy("bar")
    return out.withColumn("delta", F.col("buyvol") - F.col("sellvol")).withColumn("cumdelta", F.sum("delta").over(run))


def count_bars(tape: DataFrame, k: int) -> DataFrame:
    """Bars of k ticks a symbol and day, with what only single prints show: longest gap, largest print's share, alternation."""
    keys = ("symbol", "day")
    t = tick_sign(tape.withColumn("day", day()), keys)
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    t = t.withColumn("bar", F.floor((F.row_number().over(w) - 1) / k))
    inside = Window.partitionBy(*keys, "bar").orderBy(*ORDER)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = t.withColumns({"_gap": us - F.lag(us).over(inside), "_turn": (F.col("sign") != F.lag("sign").over(inside)).cast("int"),
        "_step": F.col("px") - F.lag("px").over(inside)})
    return t.groupBy(*keys, "bar").agg(
        F.count("*").alias("n_ticks"), F.max("_gap").alias("longest_gap_us"),
        F.round(F.max("size") / F.nullif(F.sum("size"), F.lit(0)), 6).alias("largest_share"),
        F.round(F.avg("_turn"), 6).alias("alternation"),
        F.round(F.sum(F.abs("_step")) / F.nullif(F.sum("size"), F.lit(0)), 6).alias("amihud"),
        F.round(F.sum(F.col("px") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0)), 6).alias("vwap"),
    )


def renko(tape: DataFrame, brick: float) -> DataFrame:
    """Brick level of each tick per symbol and day, and the runs of one direction."""
    keys = ("symbol", "day")
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    t = tape.withColumn("day", day()).withColumn("level", F.floor(F.col("px") / brick))
    t = t.withColumn("_d", F.signum(F.col("level") - F.lag("level").over(w)).cast("int")).where("_d <> 0")
    t = t.withColumn("_new", F.when(F.col("_d") == F.lag("_d").over(w), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return t.groupBy(*keys, "run").agg(F.first("_d").alias("direction"), F.count("*").alias("moves"), F.min("level").alias("low_level"),
        F.max("level").alias("high_level"))


def volume_profile(tape: DataFrame, width: float, top: int) -> DataFrame:
    """The price bins of most volume a symbol and day (a top-k report); equal volumes by the lower bin."""
    t = tape.groupBy("symbol", day().alias("day"), F.floor(F.col("px") / width).alias("bin")).agg(F.sum("size").alias("volume"))
    w = Window.partitionBy("symbol", "day").orderBy(F.desc("volume"), "bin")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def bucket_shares(bars: DataFrame, size: float) -> DataFrame:
    """Bars split over equal-volume buckets by overlap: (symbol, bucket, up, down), the parts of volume by the bar's direction."""
    w = Window.partitionBy("symbol").orderBy("ts")
    b = bars.withColumn("end", F.sum("volume").over(w).cast("double")).withColumn("start", F.col("end") - F.col("volume"))
    b = b.where("volume > 0").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / size), F.ceil(F.col("end") / size) - 1)))
    part = F.least("end", (F.col("bucket") + 1) * size) - F.greatest("start", F.col("bucket") * size)
    up = F.when(F.col("close") >= F.col("open"), part).otherwise(0.0)
    return b.groupBy("symbol", "bucket").agg(F.sum(up).alias("up"), (F.sum(part) - F.sum(up)).alias("down"))


def vpin(bars: DataFrame, size: float, window: int) -> DataFrame:
    """Mean absolute imbalance of the last `window` full buckets."""
    w = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(1 - window, 0)
    b = bucket_shares(bars, size).where(F.col("up") + F.col("down") >= size * (1 - 1e-9))
    return b.select("symbol", "bucket", F.when(F.count("*").over(w) == window,
        F.round(F.sum(F.abs(F.col("up") - F.col("down"))).over(w) / (size * window), 6)).alias("vpin"))
