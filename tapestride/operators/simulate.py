"""Trade simulation. Each signal's outcome is found in its own window of bars; only position gates are sequential."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PATH = "array<struct<high:double,low:double,close:double>>"


def first_touch(trades: DataFrame, tick: float = 0.0, cost: float = 0.0) -> DataFrame:
    """Resolves (side +1/-1, entry_px, stop, target, path): the stop wins a bar that touches both; at the path's end
    the last close counts; entry and exit slip by a tick against the trade, cost is taken once.

    An empty path leaves the trade out. One pass over the path per trade, no join."""
    up = F.col("side") > 0
    hit = F.transform(
        "path",
        lambda b, i: F.struct(
            (i + 1).alias("k"),
            F.when(F.when(up, b["low"] <= F.col("stop")).otherwise(b["high"] >= F.col("stop")),
            "stop").when(F.when(up, b["high"] >= F.col("target")).otherwise(b["low"] <= F.col("target")), "target").alias("why"),
        ),
    )
    t = trades.where(F.size("path") > 0).withColumn("_h", F.get(F.filter(hit, lambda x: x["why"].isNotNull()), 0))
    why = F.coalesce(F.col("_h.why"), F.lit("timeout"))
    exit_px = F.when(why == "stop", F.col("stop")).when(why == "target", F.col("target")).otherwise(F.element_at("path", -1)["close"])
    t = t.withColumns({"exit_reason": why, "bars_held": F.coalesce(F.col("_h.k"), F.size("path")), "exit_px": exit_px})
    return t.withColumn("pnl", F.col("side") * (F.col("exit_px") - F.col("entry_px")) - 2 * tick - cost).drop("_h", "path")


def excursions(trades: DataFrame) -> DataFrame:
    """Adds mae and mfe of (side, entry_px, path)."""
    hi, lo = F.array_max(F.transform("path", lambda b: b["high"])), F.array_min(F.transform("path", lambda b: b["low"]))
    up = F.col("side") > 0
    return trades.withColumns({"mfe": F.when(up, hi - F.col("entry_px")).otherwise(F.col("entry_px") - lo),
        "mae": F.when(up, lo - F.col("entry_px")).otherwise(F.col("entry_px") - hi)})


def trailing(trades: DataFrame, distance: float) -> DataFrame:
    """Exit of (side, entry_px, path) by a stop that trails the best close of earlier bars by `distance`, else the last close.

    The best close of earlier bars is a running extreme, so the exit is the first bar beyond it: no state across trades."""
    s = F.col("side")
    step = lambda acc, b: F.when(acc["done"], acc).otherwise(
        F.when(F.when(s > 0, b["low"] <= acc["best"] - distance).otherwise(b["high"] >= acc["best"] + distance),
        F.struct((acc["best"] - s * distance).alias("px"), acc["best"].alias("best"), (acc["k"] + 1).alias("k"), F.lit(True).alias("done")))
        .otherwise(F.struct(b["close"].alias("px"), F.when(s > 0,
            F.greatest(acc["best"], b["close"])).otherwise(F.least(acc["best"], b["close"])).alias("best"), (acc["k"] + 1).alias("k"),
            F.lit(False).alias("done")))
    )
    start = F.struct(F.col("entry_px").alias("px"), F.col("entry_px").alias("best"), F.lit(0).alias("k"), F.lit(False).alias("done"))
    t = trades.withColumn("_x", F.aggregate("path", start, step))
    return t.withColumns({"exit_px": F.col("_x.px"), "bars_held": F.col("_x.k"), "trailed": F.col("_x.done"),
        "pnl": s * (F.col("_x.px") - F.col("entry_px"))}).drop("_x", "path")


def pending_fill(orders: DataFrame) -> DataFrame:
    """First bar within the path that fills (kind, side, px): a limit on touch at its price, a stop at the worse of price and close of the bar before, a market order at the first close. Unfilled orders have no fill_k."""
    s, px = F.col("side"), F.col("px")
    fills = F.transform("path", lambda b, i: F.struct((i + 1).alias("k"),
        F.when(F.col("kind") == "M", True).when(F.col("kind") == "L",
        F.when(s > 0, b["low"] <= px).otherwise(b["high"] >= px)).otherwise(F.when(s > 0,
        b["high"] >= px).otherwise(b["low"] <= px)).alias("ok"), b["close"].alias("close")))
    f = F.get(F.filter(fills, lambda x: x["ok"]), 0)
    o = orders.withColumn("_f", f)
    return o.withColumns({"fill_k": F.col("_f.k"), "fill_px": F.when(F.col("_f.k").isNotNull(),
        F.when(F.col("kind") == "M", F.col("_f.close")).otherwise(px))}).drop("_f", "path")


def first_passage(bars: DataFrame, h: int, ladder: list[float]) -> DataFrame:
    """(symbol, bar_id, d, tau_up, tau_down): bars until the close of bar_id is passed by d, for each d; null beyond h."""
    from .joins import forward_path

    b = forward_path(bars, h).select("symbol", "bar_id", "close", "path", F.explode(F.array(*map(F.lit, ladder))).alias("d"))
    tau = lambda test: F.get(F.filter(F.transform("path", lambda x, i: F.when(test(x), i + 1)), lambda k: k.isNotNull()), 0)
    return b.select("symbol", "bar_id", "d", tau(lambda x: x["high"] >= F.col("close") + F.col("d")).alias("tau_up"),
        tau(lambda x: x["low"] <= F.col("close") - F.col("d")).alias("tau_down"))


def one_position(trades: DataFrame, keys: list[str], start: str, end: str, cooldown: int = 0, per_day: int | None = None,
    day: str | None = None) -> DataFrame:
    """The trades taken when a key holds one position at a time: greedy in order of (start, id).

    Sequential by nature; a key's trades are processed in one task, so make keys as fine as the book allows (symbol and
    day). Memory is that of the key's trade times."""
    schema = trades.schema

    def run(pdf):
        pdf = pdf.sort_values([start, "id"], kind="stable")
        free, taken, count = None, [], {}
        for s, e, d in zip(pdf[start], pdf[end], pdf[day] if day else [0] * len(pdf)):
            ok = (free is None or s > free) and (per_day is None or count.get(d, 0) < per_day)
            if ok:
                free, count[d] = e + cooldown, count.get(d, 0) + 1
            taken.append(ok)
        return pdf[taken]

    return trades.groupBy(*keys).applyInPandas(run, schema)


def trade_stats(trades: DataFrame, *keys: str) -> DataFrame:
    """n, win rate, mean win and loss, expectancy, profit factor (null without losses) by keys."""
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") <= 0, F.col("pnl"))
    gain, pain = F.coalesce(F.sum(win), F.lit(0.0)), F.coalesce(-F.sum(loss), F.lit(0.0))
    r = lambda c: F.round(c, 6)
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"), r(F.avg((F.col("pnl") > 0).cast("double"))).alias("win_rate"), r(F.avg(win)).alias("avg_win"),
        r(F.avg(loss)).alias("avg_loss"),
        r(F.avg("pnl")).alias("expectancy"), r(gain / F.when(pain > 0, pain)).alias("profit_factor"),
    )


def loss_streaks(trades: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Longest run of losing trades per key."""
    from .windows import run_lengths

    t = run_lengths(trades.withColumn("_l", F.col("pnl") < 0), key, order, "_l")
    return t.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("_l"), F.col("run_pos"))), F.lit(0)).alias("max_losses"))


def kelly(trades: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Adds the Kelly fraction of the n trades before each one (null while fewer), clipped to [0, 1]."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-n, -1)
    p = F.avg((F.col("pnl") > 0).cast("double")).over(w)
    win, loss = F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))).over(w), -F.avg(F.when(F.col("pnl") <= 0, F.col("pnl"))).over(w)
    f = p - (1 - p) * loss / win
    return trades.withColumn("kelly", F.when((F.count("*").over(w) == n) & win.isNotNull(),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(f, p)))))
