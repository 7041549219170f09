"""As-of, range and calendar joins. An as-of join is a union and one ordered window: one shuffle on key and day, no pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], tolerance: str | None = None, direction: str = "backward",
        strict: bool = False, order: list[str] | None = None
) -> DataFrame:
    """left with right's `values` (prefixed r_) at the last right row not after it (or the first not before it).

    Equal times match unless strict. Of right rows with one time, the last by `order` counts; without it, the one with
    the largest values. r_at is the matched time; beyond the tolerance (an interval) nothing matches. A left row is
    never multiplied or lost. Windows hold one day of a key; what earlier days (or later ones) leave is carried on a
    row a day."""
    forward = direction == "forward"
    pick = F.min_by if forward else F.max_by
    value = F.struct(*values)
    r = right.groupBy(*by, at).agg((F.max_by(value, F.struct(*order)) if order else F.max(value)).alias("_r"))
    r = r.withColumn("_day", F.to_date(at)).withColumn("_at", F.col(at))
    tags = (1, 0) if strict == forward else (0, 1)  # (left, right) among equal times
    rows = left.withColumn("_side", F.lit(tags[0])).withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withColumn("_at",
        F.lit(None).cast(r.schema[at].dataType))
    rows = rows.withColumn("_day", F.to_date(at)).withColumn("_left", F.lit(True))
    both = rows.unionByName(r.withColumn("_side", F.lit(tags[1])).withColumn("_left", F.lit(False)), allowMissingColumns=True)
    days = left.select(*by, F.to_date(at).alias("_day")).distinct().join(
        r.groupBy(*by, "_day").agg(pick(F.struct("_r", "_at"), "_at").alias("_end")), [*by, "_day"], "full")
    w = Window.partitionBy(*by).orderBy(F.desc("_day") if forward else F.asc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*by, "_day", F.last("_end", True).over(w).alias("_carried"))
    w = Window.partitionBy(*by, "_day").orderBy(at, "_side")
    frame = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    own = (F.first if forward else F.last)(F.when(~F.col("_left"), F.struct("_r", "_at")), True).over(frame)
    out = both.withColumn("_own", own).where("_left").join(days, [*by, "_day"], "left").withColumn("_hit", F.coalesce("_own", "_carried"))
    if tolerance:
        gap = F.expr(f"INTERVAL {tolerance}")
        near = F.col("_hit._at") <= F.col(at) + gap if forward else F.col("_hit._at") >= F.col(at) - gap
        out = out.withColumn("_hit", F.when(near, F.col("_hit")))
    return out.select(*left.columns, F.col("_hit._at").alias("r_at"), *(F.col(f"_hit._r.{v}").alias(f"r_{v}") for v in values))


def running_sum(df: DataFrame, by: list[str], at: str, then: list[str], value: str, name: str) -> DataFrame:
    """Adds the running sum of value by (at, then): sums within a day, on top of the days before."""
    d = df.withColumn("_day", F.to_date(at))
    days = d.groupBy(*by, "_day").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*by, "_day", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*by, "_day").orderBy(at, *then).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.sum(value).over(w)).join(days, [*by, "_day"]).withColumn(name, F.col(name) + F.col("_before")).drop("_day",
        "_before")


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """The right row nearest in time; of two equally near the earlier."""
    back = asof(left, right, by, at, values)
    named = back.select(*left.columns, *(F.col(c).alias(f"b_{c}") for c in ["r_at", *(f"r_{v}" for v in values)]))
    both = asof(named, right, by, at, values, direction="forward")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    use_back = F.col("r_at").isNull() | (F.col("b_r_at").isNotNull() & (us(at) - us("b_r_at") <= us("r_at") - us(at)))
    return both.select(*left.columns, *(F.when(use_back, F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) for c in ["r_at",
        *(f"r_{v}" for v in values)]))


def within(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, cell_seconds: int) -> DataFrame:
    """points in [start, end] of spans of the same key: an equi-join on time cells, then the exact test.

    A span is copied to the cells it touches, so choose cells about as long as spans."""
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    p = points.withColumn("_cell", F.floor(sec(at) / cell_seconds))
    s = spans.withColumn("_cell", F.explode(F.sequence(F.floor(sec(start) / cell_seconds), F.floor(sec(end) / cell_seconds))))
    return p.join(s, [*by, "_cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_cell")


def forward_path(bars: DataFrame, h: int) -> DataFrame:
    """Adds path: array of the next h bars' (high, low, close, open); one window, no self-join."""
    w = Window.partitionBy("symbol").orderBy("bar_id").rowsBetween(1, h)
    return bars.withColumn("path", F.collect_list(F.struct("high", "low", "close", "open")).over(w))


def previous_day(bars: DataFrame) -> DataFrame:
    """Adds day and the previous trading day's high, low, close, and floor pivots; the daily table is an aggregate of the bars."""
    b = bars.withColumn("day", F.to_date("ts"))
    d = b.groupBy("symbol", "day").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c"))
    w = Window.partitionBy("symbol").orderBy("day")
    d = d.select("symbol", "day", F.lag("h").over(w).alias("pdh"), F.lag("l").over(w).alias("pdl"), F.lag("c").over(w).alias("pdc"))
    d = d.withColumn("pivot", (F.col("pdh") + F.col("pdl") + F.col("pdc")) / 3)
    d = d.withColumns({"r1": 2 * F.col("pivot") - F.col("pdl"), "s1": 2 * F.col("pivot") - F.col("pdh"),
        "r2": F.col("pivot") + F.col("pdh") - F.col("pdl"), "s2": F.col("pivot") - F.col("pdh") + F.col("pdl")})
    return b.join(d, ["symbol", "day"])


def on_calendar(df: DataFrame, key: str, day: str, values: list[str]) -> DataFrame:
    """Every day from a key's first to its last, values carried forward."""
    span = df.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    spine = span.select(key, F.explode(F.sequence("_a", "_b")).alias(day))
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(df, [key, day], "left").select(key, day, *(F.last(v, True).over(w).alias(v) for v in values))


def grid(**axes: list) -> Column:
    """Array of structs, the product of the axes; explode it for a parameter grid."""
    from itertools import product

    return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(axes, values))) for values in product(*axes.values())))


def pairs_of_masks(masks: DataFrame, least: int) -> DataFrame:
    """All pairs of conditions that hold together in `least` bars or more: (a, b, n, mean_fwd), t-like score.

    masks: one row per bar, with conds (ascending array of condition names that hold) and fwd. Pairs are made inside
    a bar's own short array, then counted with partial aggregation."""
    each = masks.select("fwd", F.explode(F.transform("conds", lambda x,
        i: F.struct(x.alias("a"), F.slice(F.col("conds"), i + 2, F.size("conds")).alias("rest")))).alias("x"))
    both = each.select("fwd", F.col("x.a").alias("a"), F.explode("x.rest").alias("b"))
    out = both.groupBy("a", "b").agg(F.count("fwd").alias("n"), F.avg("fwd").alias("mean_fwd"),
        F.stddev_samp("fwd").alias("sd")).where(F.col("n") >= least)
    return out.withColumn("score", F.col("mean_fwd") * F.sqrt("n") / F.when(F.col("sd") > 0, F.col("sd"))).drop("sd")
