"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_tick(px: Column, tick: float, how: str = "nearest") -> Column:
    """px on the tick grid: nearest (halves to even), down or up."""
    x = px / tick
    return {"nearest": F.bround(x), "down": F.floor(F.round(x, 9)), "up": F.ceil(F.round(x, 9))}[how] * tick


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def guarded(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def floored(a: Column, b: Column, least: float = 1e-9) -> Column:
    """a / max(b, least)."""
    return a / F.greatest(b, F.lit(least))


def third_friday(day: Column) -> Column:
    return F.date_add(F.next_day(F.date_add(F.trunc(day, "month"), -1), "Fri"), 14)


def trading_day(ts: Column, roll_hour_utc: int = 22) -> Column:
    """The day a session that begins at roll_hour belongs to."""
    return F.to_date(ts + F.expr(f"INTERVAL {24 - roll_hour_utc} HOURS"))


def new_york(ts: Column) -> Column:
    """Wall clock in New York of a UTC time."""
    return F.from_utc_timestamp(ts.cast("timestamp"), "America/New_York")


def epoch_time(n: Column) -> Column:
    """Timestamp of a number in s, ms, us or ns, told by its magnitude."""
    return F.timestamp_micros(F.when(n > 10**17, F.floor(n / 1000)).when(n > 10**14, n).when(n > 10**11,
        n * 1000).otherwise(n * 1_000_000).cast("long"))


def amount_midpoint(text: Column) -> Column:
    """Middle of `$1,001 - $15,000`; of one number itself."""
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(text, ",", ""), F.lit(r"(\d+(?:\.\d+)?)")), lambda x: x.cast("double"))
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))


def mentions(text: Column, words: list[str]) -> Column:
    """How often the words occur, as whole words, any case."""
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(words) + r")\b")))


def normal_cdf(x: Column) -> Column:
    """Polynomial of five terms; absolute error below 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def d1(spot: Column, strike: Column, years: Column, vol: Column, rate: float = 0.0) -> Column:
    return (F.ln(spot / strike) + (rate + vol * vol / 2) * years) / (vol * F.sqrt(years))


def option_price(spot: Column, strike: Column, years: Column, vol: Column, call: Column, rate: float = 0.0) -> Column:
    a = d1(spot, strike, years, vol, rate)
    b, disc = a - vol * F.sqrt(years), F.exp(-rate * years)
    c = spot * normal_cdf(a) - strike * disc * normal_cdf(b)
    return F.when(call, c).otherwise(c - spot + strike * disc)


def option_gamma(spot: Column, strike: Column, years: Column, vol: Column) -> Column:
    a = d1(spot, strike, years, vol)
    return F.exp(-a * a / 2) / math.sqrt(2 * math.pi) / (spot * vol * F.sqrt(years))


def implied_vol(price: Column, spot: Column, strike: Column, years: Column, call: Column, rounds: int = 40) -> Column:
    """Bisection between 0.1 % and 500 %, as one fold over a counter: no Python, no state."""
    span = F.struct(F.lit(0.001).alias("lo"), F.lit(5.0).alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        low = option_price(spot, strike, years, mid, call) < price
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), span, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def impulse_setup(opens: Column, close: Column, hi: Column, lo: Column, impulse: float = 5.0, pullback: float = 0.618, stop: float = 6.0,
    target: float = 12.0) -> Column:
    """Limit setup after an impulse of the last bars: struct of side, net, entry, stop, target; null below the impulse."""
    net = close - opens
    side = F.when(net >= impulse, 1).when(net <= -impulse, -1)
    entry = F.when(side > 0, hi - pullback * (hi - lo)).otherwise(lo + pullback * (hi - lo))
    return F.when(side.isNotNull(), F.struct(side.alias("side"), net.alias("net"), F.round(entry, 2).alias("entry"),
        F.round(entry - side * stop, 2).alias("stop"), F.round(entry + side * target, 2).alias("target")))


def available_mean(weights: dict[str, float]) -> Column:
    """Weighted mean of the columns that aren't null; null if none is there."""
    total = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0))


def rule_terms(text: Column) -> Column:
    """Terms of a rule such as "f>q0.7 & g<=q0.6": array of (feature, op, q)."""
    term = r"^\s*(\w+)\s*(<=|>=|<|>)\s*q([0-9.]+)\s*$"
    part = lambda t, k: F.regexp_extract(t, term, k)
    return F.transform(F.split(text, "&"), lambda t: F.struct(part(t, 1).alias("feature"), part(t, 2).alias("op"),
        part(t, 3).cast("double").alias("q")))


def padded_key(*parts: Column, width: int) -> Column:
    """The first part zero-padded, joined to the others by an underscore."""
    first, *rest = (p.cast("string") for p in parts)
    return F.concat_ws("_", F.lpad(first, width, "0"), *rest)


def round_level(px: Column, step: float) -> Column:
    """The nearest multiple of step, ties to even."""
    return F.bround(px / step) * step


def slippage(volume_ratio: Column, contracts: Column, base: float = 1.5, size: float = 30.0) -> Column:
    """Points lost by an order: more for size, more on a thin book, half a point at least."""
    thin = F.greatest(F.lit(0.0), 1 - F.coalesce(volume_ratio, F.lit(1.0))) * 1.5
    return F.greatest(F.lit(0.5), base + 0.5 * (contracts / size - 1) + thin)


def looked_up(key: Column, table: dict) -> Column:
    """The key's value in a small fixed table, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def kelly_from_profit_factor(win_rate: Column, profit_factor: Column) -> Column:
    """Kelly fraction from win rate and profit factor, clipped to [0, 1]; 0 where either says nothing."""
    odds = profit_factor * (1 - win_rate) / win_rate
    f = win_rate - (1 - win_rate) / odds
    return F.when((win_rate > 0) & (win_rate < 1) & (profit_factor > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), f))).otherwise(0.0)
