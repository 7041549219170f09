"""Signals: boolean columns over bars, emitted as event rows in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .joins import previous_day


def emit(bars: DataFrame, masks: dict[str, tuple[int, Column]], carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per signal that is on: signal_time, signal_name, side, entry_px."""
    on = [F.when(mask, F.struct(F.lit(name).alias("signal_name"), F.lit(side).alias("side"))) for name, (side, mask) in masks.items()]
    return bars.withColumn("_s", F.explode(F.array_compact(F.array(*on)))).select("symbol", "bar_id", F.col("ts").alias("signal_time"),
        "_s.signal_name", "_s.side", F.col("close").alias("entry_px"), *carry)


def core(bars: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Previous-day touches, midpoint, z-score, compression and VWAP signals over bars."""
    w = W.by_symbol()
    b = W.session_vwap(previous_day(bars).drop("day"))
    day = Window.partitionBy("symbol", "day").orderBy("ts")
    prev = F.lag("close").over(w)
    eq = (F.max("high").over(W.last_n(20)) + F.min("low").over(W.last_n(20))) / 2
    b = b.withColumns({"_z": W.zscore("close", 20), "_prev": prev, "_eq": eq, "_vw": F.lag("vwap").over(day),
        "_pc": F.lag("close").over(day), "_r": F.avg(F.col("high") - F.col("low")).over(W.last_n(5)),
        "_rr": F.avg(F.col("high") - F.col("low")).over(W.last_n(20)), "_open": F.first("open").over(day)})
    up, down = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    c = F.col("close")
    # fixed values: the names of the core signals
    return emit(b, {
        "PDL_TOUCH": (1, (F.col("low") <= F.col("pdl")) & (c > F.col("pdl"))),
        "PDH_TOUCH": (-1, (F.col("high") >= F.col("pdh")) & (c < F.col("pdh"))),
        "EQ50_LONG": (1, (F.col("low") <= F.col("_eq")) & (c > F.col("_eq")) & up),
        "EQ50_SHORT": (-1, (F.col("high") >= F.col("_eq")) & (c < F.col("_eq")) & down),
        "GAP_FILL_LONG": (1, (F.col("_open") < F.col("pdc")) & (c < F.col("pdc")) & up),
        "GAP_FILL_SHORT": (-1, (F.col("_open") > F.col("pdc")) & (c > F.col("pdc")) & down),
        "ZSCORE_LONG": (1, F.col("_z") < -1.5), "ZSCORE_SHORT": (-1, F.col("_z") > 1.5),
        "VOL_COMP_LONG": (1, (F.col("_r") < 0.8 * F.col("_rr")) & up), "VOL_COMP_SHORT": (-1, (F.col("_r") < 0.8 * F.col("_rr")) & down),
        "VWAP_RECLAIM_LONG": (1, (F.col("_pc") < F.col("_vw")) & (c > F.col("vwap"))),
        "VWAP_REJECT_SHORT": (-1, (F.col("_pc") > F.col("_vw")) & (c < F.col("vwap"))),
    }, carry)


def gate(signals: DataFrame, checks: list[tuple[str, Column, float]]) -> DataFrame:
    """Adds veto (the first failed check's name, or null) and size, the product of the multipliers of soft checks that fail.

    A check: (name, passes, multiplier); multiplier 0 vetoes. A null test fails."""
    veto = veto_of(checks)
    size = F.lit(1.0)
    for _, ok, mult in checks:
        if mult:
            size = size * F.when(F.coalesce(ok, F.lit(False)), 1.0).otherwise(mult)
    return signals.withColumns({"veto": veto, "size": F.when(veto.isNull(), F.round(size, 6)).otherwise(0.0)})


def veto_of(checks: list[tuple[str, Column, float]]) -> Column:
    """The first check without a multiplier that fails, or null."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok, mult in checks if not mult), F.lit(None).cast("string"))
