"""Checks, sizes and limits that stand between a signal and a trade."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .stats import correlation

# Families of signals that a check leaves alone, and least ratios of target to stop.
BIAS_EXEMPT = ("GAP_FILL_", "PDL_", "PDH_", "FAILED_BREAKDOWN")
ZONE_EXEMPT = ("PDL_BSL_SWEEP", "PDH_BSL_SWEEP", "PDL_TOUCH", "PDH_TOUCH", "POWERHOUR_REVERT_", "FAILED_BREAKDOWN_", "PDH_FLIP_",
    "THREE_HIGHER_LOWS_")
LEVEL_EXEMPT = ("PDL_", "PDH_", "VWAP_", "THIRD_VWAP_", "STOPRUN_", "BIGBAR_", "ASIAN_BREAK_", "POWERHOUR_", "FAILED_BREAKDOWN_",
    "PDH_FLIP_", "THREE_HIGHER_LOWS_", "GAP_FILL_")
LEAST_RATIO = {"GAP_FILL_SHORT": 4.0, "GAP_FILL_LONG": 1.3, "VWAP_RECLAIM_LONG": 1.5, "VWAP_REJECT_SHORT": 1.5}
FAMILY_RATIO = {"MINED_": 2.0, "WR_": 0.8, "V3_": 1.8}


def begins_with(name: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(name, F.lit(p))
    return out


def bias_allows(name: Column, side: Column, bias: Column) -> Column:
    """bias: sum of the last three candles' directions; only three against the side forbid it."""
    b = F.coalesce(bias, F.lit(0))
    return begins_with(name, BIAS_EXEMPT) | F.when(side > 0, b > -3).otherwise(b < 3)


def near_level(name: Column, px: Column, levels: list[Column], points: float) -> Column:
    """Whether a known level is within `points`; true where no level is known."""
    gaps = F.array_compact(F.array(*(F.when(x > 0, F.abs(px - x)) for x in levels)))
    return begins_with(name, LEVEL_EXEMPT) | (F.size(gaps) == 0) | (F.array_min(gaps) <= points)


def derived_target(name: Column, side: Column, px: Column, previous_close: Column, middle: Column, hint: Column | None = None) -> Column:
    """A signal's own anchor as target: a given hint, the close before, the middle of the range, or fixed points."""
    ahead = lambda points: px + points * side
    own = F.when(begins_with(name, ("GAP_FILL_", "PREV_CLOSE_")), F.coalesce(F.when(previous_close > 0, previous_close), middle, px))
    own = own.when(begins_with(name, ("PDL_TOUCH", "PDH_TOUCH")),
        F.coalesce(middle, ahead(30))).when(begins_with(name, ("PDL_", "FAILED_BREAKDOWN_")), F.coalesce(middle, px + 30))
    own = own.when(begins_with(name, ("PDH_",)), F.coalesce(middle, px - 30)).when(begins_with(name, ("EQ50_",)), F.coalesce(middle, px))
    own = own.when(begins_with(name, ("ZSCORE_",)), ahead(25)).when(begins_with(name, ("VWAP_", "THIRD_VWAP_")),
        ahead(20)).otherwise(ahead(30))
    return own if hint is None else F.when(hint > 0, hint).otherwise(own)


def least_ratio(name: Column) -> Column:
    out = None
    for p, x in FAMILY_RATIO.items():
        out = F.when(F.startswith(name, F.lit(p)), x) if out is None else out.when(F.startswith(name, F.lit(p)), x)
    for n, x in LEAST_RATIO.items():
        out = out.when(name == n, x)
    return out.otherwise(2.0)


def reward_ratio(side: Column, px: Column, stop_points: Column, target: Column) -> Column:
    """Points to the target over points to the stop; null where either is on the wrong side."""
    points = side * (target - px)
    return F.when((stop_points > 0) & (points > 0), points / stop_points)


def vol_regime(bars: DataFrame) -> DataFrame:
    """(symbol, day, regime, stop_points, size_mult) from the ranges of the 5 and 20 completed days before; NORMAL while fewer."""
    d = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg((F.max("high") - F.min("low")).alias("_r"))
    w = Window.partitionBy("symbol").orderBy("day")
    long, short = w.rowsBetween(-20, -1), w.rowsBetween(-5, -1)
    ratio = F.when(F.count("_r").over(long) == 20, F.avg("_r").over(short) / F.nullif(F.avg("_r").over(long), F.lit(0.0)))
    regime = F.when(ratio > 1.5, "HIGH").when(ratio < 0.7, "LOW").otherwise("NORMAL")
    d = d.withColumn("regime", regime)
    return d.select("symbol", "day", "regime", F.when(F.col("regime") == "HIGH", 20.0).when(F.col("regime") == "LOW",
        10.0).otherwise(15.0).alias("stop_points"), F.when(F.col("regime") == "HIGH", 0.5).otherwise(1.0).alias("size_mult"))


def adverse_selection(bars: DataFrame) -> DataFrame:
    """Adds score (0 to 1) and as_regime: spread against its mean, its change, serial correlation of returns, volume imbalance; a market in shutdown scores 0.9 at least."""
    w = W.by_symbol()
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    before = F.lag("close").over(w)
    b = bars.withColumns({"_s": F.col("high") - F.col("low"), "_ret": F.ln("close") - F.ln(before),
        "_dir": F.when(F.col("close") < before, -1).otherwise(1)})
    b = b.withColumns({"_base": F.greatest(F.when(F.count("_s").over(W.last_n(20)) >= 5, F.avg("_s").over(W.last_n(20))), F.lit(1e-9)),
        "_ds": F.col("_s") - F.lag("_s").over(w), "_pr": F.lag("_ret").over(w)})
    imbalance = F.abs(F.sum(F.col("volume") * F.col("_dir")).over(W.last_n(20))) / F.nullif(F.sum("volume").over(W.last_n(20)), F.lit(0))
    serial = F.least(F.lit(1.0), F.abs(F.coalesce(correlation("_ret", "_pr", W.last_n(49)), F.lit(0.0))))
    score = 0.35 * unit((F.col("_s") / F.col("_base") - 1) / 2) + 0.2 * unit(F.avg("_ds").over(W.last_n(5)) / F.col("_base") * 5) + 0.25 * serial + 0.2 * F.coalesce(imbalance, F.lit(0.0))
    mean = lambda c: F.when(F.count("*").over(W.last_n(50)) == 50, F.avg(c).over(W.last_n(50)))
    shut = (F.col("_s") > 3 * mean("_s")) & (mean("_s") > 0) & (F.col("volume") < 0.3 * mean("volume")) & (mean("volume") > 0)
    b = b.withColumn("score", F.when(F.row_number().over(w) < 30,
        0.3).otherwise(F.when(F.coalesce(shut, F.lit(False)), F.greatest(unit(score), F.lit(0.9))).otherwise(unit(score))))
    s = F.round("score", 9)
    regime = F.when(s < 0.3, "LOW").when(s < 0.5, "NORMAL").when(s < 0.7, "ELEVATED").when(s < 0.85, "HIGH").otherwise("EXTREME")
    return b.withColumn("as_regime", regime).drop("_s", "_ret", "_dir", "_base", "_ds", "_pr")


def fresh_gate(rows: DataFrame, daily: DataFrame, at: str, day: str, value: str, limit: Column, days: int = 5) -> DataFrame:
    """Adds gate_open: the last daily value before the row's day passes `limit` (a condition on `value`) and is at most `days` old; missing is closed."""
    from .joins import asof

    d = daily.select(F.date_add(day, 1).cast("timestamp_ntz").alias(at), F.col(day).alias("_of"), value).withColumn("_k", F.lit(1))
    x = asof(rows.withColumn("_k", F.lit(1)), d, ["_k"], at, ["_of", value])
    ok = (F.datediff(F.to_date(at), "r__of") <= days) & limit
    return x.withColumn(value, F.col(f"r_{value}")).withColumn("gate_open", F.coalesce(ok, F.lit(False))).drop("_k", "r_at", "r__of",
        f"r_{value}")


def position_size(kelly: Column, confidence: Column, mults: list[Column], base: float = 2.0, cap: float = 0.25, most: int = 10) -> Column:
    """Contracts: the base, raised by capped Kelly, times the multipliers and the model's confidence; a zero multiplier means none."""
    scale = F.greatest(F.lit(0.5), F.least(F.lit(1.5), 1.4 + 1.6 * (confidence - 0.5)))
    product = scale
    for m in mults:
        product = product * m
    raw = base * (1 + 4 * kelly * cap) * product
    return F.when(product <= 0, 0).otherwise(F.least(F.lit(most), F.bround(F.greatest(F.lit(0.0), raw))).cast("int"))


def model_confirms(side: Column, predicted: Column, confidence: Column, least: float = 0.55) -> Column:
    """AGREE, REDUCE (unsure or neutral) or REJECT (sure of the other side)."""
    return F.when(confidence < least, "REDUCE").when(predicted == side, "AGREE").when(predicted == -side, "REJECT").otherwise("REDUCE")


def prop_audit(days: DataFrame, book: str, day: str, value: str, target: float, least_days: int, share: float) -> DataFrame:
    """Per book: profit, trading days, the best day's share of the profit, and whether a payout may be asked for."""
    a = days.groupBy(book).agg(F.sum(value).alias("profit"), F.count("*").alias("days"), F.max(value).alias("best_day"))
    part = F.when(F.col("profit") > 0, F.col("best_day") / F.col("profit"))
    why = F.when(F.col("profit") < target, "profit").when(F.col("days") < least_days, "days").when(part > share,
        "consistency").otherwise("eligible")
    return a.select(book, F.round("profit", 4).alias("profit"), "days", F.round(part, 6).alias("best_share"), why.alias("verdict"))


#: How a chain of checks is set: which of them veto, and the size that a failed soft check leaves.
MODES = {
    "STRICT": {"bias": 0, "zone": 0, "level": 0, "ratio": 0, "adverse": 0},
    "MODERATE": {"bias": 0, "zone": 0.5, "level": 0.5, "ratio": 0, "adverse": 0},
    "AGGRESSIVE": {"bias": 0.5, "zone": 0.5, "level": 0.5, "ratio": 0, "adverse": 0},
    "LEAN": {"bias": 0.5, "zone": 1.0, "level": 1.0, "ratio": 0, "adverse": 0},
}


@dataclass(frozen=True)
class Limits:
    """Limits of a book; None or 0 switches one off."""

    cooldown: float = 0.0  # seconds since the last exit
    per_day: int | None = None
    losses: int | None = None  # in a row, then a pause of so many seconds
    pause: float = 3600.0
    day_loss: float | None = None  # the rest of the day is locked
    start: float = 50_000.0
    trail: float | None = None  # distance of the floor below the best end of day
    buffer: float = 0.0
    one_position: bool = True
    windows: tuple[tuple[int, int], ...] = ((0, 24),)
    sizes: tuple[tuple[float, int], ...] = field(default=((0.0, 1),))  # (distance to the floor, quantity), the largest first


def account_gates(trades: DataFrame, book: str, limits: Limits) -> DataFrame:
    """The trades of a book with `denied` (the first gate that refuses, or null) and `qty`, in order of (entry, id).

    trades: book, id, entry and exit (timestamps), pnl for one contract. Each gate asks what earlier accepted trades left
    behind, so a book is walked in order; books are spread, and a book's trades are small beside the tape. A trade's
    result counts from its exit on."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entry", "id"], kind="stable")
        open_trades, closed_at, run_of_losses, locked, balance, peak = [], None, 0, None, limits.start, limits.start
        today, day_pnl, taken, why, qty = None, 0.0, 0, [], []
        for entry, end, pnl in zip(pdf["entry"], pdf["exit"], pdf["pnl"]):
            for t in sorted(open_trades):
                if t[0] > entry:
                    break
                open_trades.remove(t)
                if t[0].date() != today:
                    peak, today, day_pnl, taken = max(peak, balance), t[0].date(), 0.0, 0
                closed_at, balance, day_pnl = t[0], balance + t[1], day_pnl + t[1]
                run_of_losses = run_of_losses + 1 if t[1] < 0 else 0
            if entry.date() != today:
                peak, today, day_pnl, taken = max(peak, balance), entry.date(), 0.0, 0
            distance = float("inf") if limits.trail is None else balance - (peak - limits.trail)
            n = next((q for d, q in sorted(limits.sizes, reverse=True) if distance >= d), 0)
            reason = None
            if locked is not None and entry < locked:
                reason = "locked"
            elif limits.day_loss and day_pnl <= -limits.day_loss:
                reason, locked = "day loss", (entry + pd.Timedelta(days=1)).normalize()
            elif distance < limits.buffer:
                reason = "floor"
            elif limits.losses and run_of_losses >= limits.losses:
                reason, locked, run_of_losses = "losses", entry + pd.Timedelta(seconds=limits.pause), 0
            elif limits.per_day is not None and taken >= limits.per_day:
                reason = "per day"
            elif limits.cooldown and closed_at is not None and (entry - closed_at).total_seconds() < limits.cooldown:
                reason = "cooldown"
            elif limits.one_position and open_trades:
                reason = "position"
            elif not any(a <= entry.hour < z for a, z in limits.windows):
                reason = "window"
            elif n == 0:
                reason = "size"
            if reason is None:
                taken += 1
                open_trades.append((end, pnl * n))
            why.append(reason)
            qty.append(0 if reason else n)
        return pdf.assign(denied=why, qty=qty)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trades.schema) + ", denied string, qty int"
    return trades.groupBy(book).applyInPandas(run, ddl)


def book_limits(trades: DataFrame, book: str, root: str, most_open: int, margin_cap: float,
    glide: tuple[float, float] = (1.0, 0.0)) -> DataFrame:
    """The trades of a book, over all its streams, with `denied`: netting (an open trade of the same root and the other
    side), root (the same side is open already), open (too many) or margin (dollars in use beyond the cap).

    trades: book, root, id, entry, exit, side, margin. glide: the share of the cap at the first trade, and what each
    accepted trade adds to it, up to the whole. State is the book's, so streams of a book are walked together."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entry", "id"], kind="stable")
        held, why, taken = [], [], 0
        for entry, end, side, name, margin in zip(pdf["entry"], pdf["exit"], pdf["side"], pdf[root], pdf["margin"]):
            held = [h for h in held if h[0] > entry]
            cap = margin_cap * min(1.0, glide[0] + glide[1] * taken)
            same = [h for h in held if h[1] == name]
            reason = "netting" if any(h[2] != side for h in same) else "root" if same else "open" if len(held) >= most_open else "margin" if sum(h[3] for h in held) + margin > cap else None
            if reason is None:
                held.append((end, name, side, margin))
                taken += 1
            why.append(reason)
        return pdf.assign(denied=why)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trades.schema) + ", denied string"
    return trades.groupBy(book).applyInPandas(run, ddl)
