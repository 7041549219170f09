"""Fills and exits beyond first touch: time to live, break-even, ticks and quotes, arming, chance, ratchets, dead bands.

Each looks at its own path of later bars or ticks; nothing is carried from one trade to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import ORDER, day
from .validate import draw


def first_of(path: str | Column, test, value=None) -> Column:
    """1-based place (or value) of the first element of the path for which test(element, index) holds."""
    p = F.col(path) if isinstance(path, str) else path
    hit = F.transform(p, lambda b, i: F.when(test(b, i), (i + 1) if value is None else value(b, i)))
    return F.get(F.filter(hit, lambda x: x.isNotNull()), 0)


def fill_within(orders: DataFrame, ttl: int, tick: float) -> DataFrame:
    """Fills orders (kind, side, px, path) in the path's first `ttl` bars: a limit on touch at its price, a stop a tick
    beyond the worse of open and price, a market order a tick beyond the first open. Adds fill_k and fill_px."""
    s, px = F.col("side"), F.col("px")
    limit = lambda b: F.when(s > 0, b["low"] <= px).otherwise(b["high"] >= px)
    stop = lambda b: F.when(s > 0, b["high"] >= px).otherwise(b["low"] <= px)
    ok = lambda b, i: F.when(F.col("kind") == "M", True).when(F.col("kind") == "L", limit(b)).otherwise(stop(b))
    o = orders.withColumn("_p", F.slice("path", 1, ttl)).withColumn("fill_k", first_of("_p", ok))
    at = F.get("_p", F.col("fill_k") - 1)["open"]
    beyond = F.when(s > 0, F.greatest(at, px)).otherwise(F.least(at, px)) + s * tick
    return o.withColumn("fill_px", F.when(F.col("fill_k").isNotNull(),
        F.when(F.col("kind") == "L", px).when(F.col("kind") == "M", at + s * tick).otherwise(beyond))).drop("_p", "path")


def break_even(trades: DataFrame, stop: float, target: float, trigger: float) -> DataFrame:
    """Exit of (side, entry_px, path): once a bar has gone `trigger` in favour, from the next bar on the stop is the entry;
    the stop wins a bar that touches both; else the last close. Adds moved, bars_held, exit_reason, pnl."""
    s, e = F.col("side"), F.col("entry_px")
    gone = lambda b: F.when(s > 0, b["high"] - e).otherwise(e - b["low"])
    t = trades.withColumn("_a", first_of("path", lambda b, i: gone(b) >= trigger))
    level = lambda i: F.when(i + 1 > F.col("_a"), e).otherwise(e - s * stop)
    hit = lambda b, i: F.when(F.when(s > 0, b["low"] <= level(i)).otherwise(b["high"] >= level(i)),
        F.struct((i + 1).alias("k"), F.lit("stop").alias("why"), level(i).alias("px"))).when(
        gone(b) >= target, F.struct((i + 1).alias("k"), F.lit("target").alias("why"), (e + s * target).alias("px")))
    t = t.withColumn("_x", F.get(F.filter(F.transform("path", hit), lambda x: x.isNotNull()), 0))
    px = F.coalesce("_x.px", F.element_at("path", -1)["close"])
    out = {"bars_held": F.coalesce("_x.k", F.size("path")), "exit_reason": F.coalesce("_x.why", F.lit("timeout")), "pnl": s * (px - e)}
    return t.withColumns(out).withColumn("moved", F.coalesce(F.col("_a") < F.col("bars_held"), F.lit(False))).drop("_a", "_x", "path")


def tick_paths(tape: DataFrame, n: int) -> DataFrame:
    """Adds path: the next n ticks (us, px) of the symbol's day."""
    t = tape.withColumn("day", day()).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("symbol", "day").orderBy(*ORDER).rowsBetween(1, n)
    return t.withColumn("path", F.collect_list(F.struct("us", "px")).over(w))


def tick_trades(signals: DataFrame, latency: int, spread: float, stop: float, target: float, hold: int) -> DataFrame:
    """Trades of (side, us, path of ticks): the entry is the first tick `latency` microseconds after the signal, paid at
    the ask or sold at the bid, half a spread from the print; a long leaves on the bid, a short on the ask. The stop
    counts at once, the target only `hold` microseconds after the entry; else the last tick. Without a tick to enter on,
    or one after it, there is no trade."""
    s, half = F.col("side"), spread / 2
    t = signals.withColumn("_k", first_of("path", lambda b, i: b["us"] >= F.col("us") + latency)).where("_k < size(path)")
    t = t.withColumn("_in", F.get("path", F.col("_k") - 1)).withColumn("entry_px", F.col("_in.px") + s * half)
    side_px = lambda b: b["px"] - s * half
    gain = lambda b: s * (side_px(b) - F.col("entry_px"))
    after = F.slice("path", F.col("_k") + 1, F.size("path"))
    why = lambda b: F.when(gain(b) <= -stop, "stop").when((gain(b) >= target) & (b["us"] >= F.col("_in.us") + hold), "target")
    hits = F.filter(F.transform(after, lambda b: F.struct(why(b).alias("why"), side_px(b).alias("px"))), lambda x: x["why"].isNotNull())
    t = t.withColumn("_x", F.get(hits, 0)).withColumn("_last", F.element_at("path", -1)["px"] - s * half)
    return t.withColumns({"exit_reason": F.coalesce("_x.why", F.lit("timeout")),
        "pnl": s * (F.coalesce("_x.px", "_last") - F.col("entry_px"))}).drop("_k", "_in", "_x", "_last", "path")


def armed_limit(orders: DataFrame, arm: float) -> DataFrame:
    """A limit (side, px, path) that rests only once price has been `arm` on its far side: adds armed_k and fill_k, the first
    bar that arms it and the first later one that touches it."""
    s, px = F.col("side"), F.col("px")
    far = lambda b, i: F.when(s > 0, b["high"] >= px + arm).otherwise(b["low"] <= px - arm)
    o = orders.withColumn("armed_k", first_of("path", far))
    touch = lambda b, i: (i + 1 > F.col("armed_k")) & F.when(s > 0, b["low"] <= px).otherwise(b["high"] >= px)
    return o.withColumn("fill_k", first_of("path", touch)).drop("path")


def chance_fill(orders: DataFrame, order_id: str, chances: list[tuple[float, float]], seed: str = "fill") -> DataFrame:
    """A limit (side, px, path) that fills by chance: chances holds (least penetration, probability), ascending; draws are
    hashes of the order and the bar, so any task can repeat them. Adds fill_k."""
    s, px = F.col("side"), F.col("px")
    depth = lambda b: F.when(s > 0, px - b["low"]).otherwise(b["high"] - px)

    def p(b):
        out = F.lit(0.0)
        for least, chance in chances:
            out = F.when(depth(b) >= least, chance).otherwise(out)
        return out

    hit = lambda b, i: draw(F.lit(seed), F.col(order_id).cast("string"), (i + 1).cast("string")) < p(b)
    return orders.withColumn("fill_k", first_of("path", hit)).drop("path")


def dead_band(bars: DataFrame, keys: list[str], order: str, wanted: str, band: float) -> DataFrame:
    """Adds position: it moves to the wanted one only when that is more than `band` away; zero at a key's beginning.

    A key's bars are folded in order on one row, so make keys short (symbol and day)."""
    rows = bars.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, wanted))).alias("_r"))
    step = lambda acc, x: F.array_append(acc, F.when(F.abs(x[wanted] - F.element_at(acc, -1)) > band,
        x[wanted]).otherwise(F.element_at(acc, -1)))
    out = rows.withColumn("_p", F.aggregate("_r", F.array(F.lit(0.0)), step))
    out = out.select(*keys, F.posexplode("_r").alias("_i", "_x"), "_p").select(*keys, F.col(f"_x.{order}").alias(order),
        F.get("_p", F.col("_i") + 1).alias("position"))
    return bars.join(out, [*keys, order])


def ratchet(trades: DataFrame, atr: str, k: float, tick: float) -> DataFrame:
    """Exit of (side, entry_px, path) by a stop k ATRs behind the extreme since the fill that only moves by a tick or more.

    Adds exit_px, bars_held, stopped; a bar's own extreme moves the stop for later bars only."""
    s, d = F.col("side"), F.col(atr) * k
    out = lambda acc, b: F.when(s > 0, b["low"] <= acc["stop"]).otherwise(b["high"] >= acc["stop"])
    best = lambda acc, b: F.when(s > 0, F.greatest(acc["best"], b["high"])).otherwise(F.least(acc["best"], b["low"]))

    def step(acc, b):
        wanted = best(acc, b) - s * d
        moved = F.when(s * (wanted - acc["stop"]) >= tick, wanted).otherwise(acc["stop"])
        state = lambda px, top, stop, k, done: F.struct(px.alias("px"), top.alias("best"), stop.alias("stop"), k.alias("k"),
            F.lit(done).alias("done"))
        return F.when(acc["done"], acc).when(out(acc, b), state(acc["stop"], acc["best"], acc["stop"], acc["k"] + 1,
            True)).otherwise(state(b["close"], best(acc, b), moved, acc["k"] + 1, False))

    e = F.col("entry_px")
    start = F.struct(e.alias("px"), e.alias("best"), (e - s * d).alias("stop"), F.lit(0).alias("k"), F.lit(False).alias("done"))
    t = trades.withColumn("_x", F.aggregate("path", start, step))
    return t.withColumns({"exit_px": F.col("_x.px"), "bars_held": F.col("_x.k"), "stopped": F.col("_x.done")}).drop("_x", "path")
