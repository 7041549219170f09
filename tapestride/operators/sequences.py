"""Operators that walk a symbol's bars in order, and rules and learners over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .stats import quantiles


def streamed(bars: DataFrame, key: str, order: str, ddl: str, start: Callable[[], object],
    step: Callable[[object, object], list[tuple]]) -> DataFrame:
    """Rows that step(state, row) gives, called for a key's rows in order; a fresh state from start() for each key.

    Rows stream through one task a key, batch after batch; only the state is held."""
    import pandas as pd

    names = [f.split()[0].strip("`") for f in ddl.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            rows: list[tuple] = []
            for row in pdf.itertuples(index=False):
                if getattr(row, key) != now:
                    now, state = getattr(row, key), start()
                rows += step(state, row)
            yield pd.DataFrame(rows, columns=names)

    return bars.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, ddl)


def parabolic(bars: DataFrame, first: float = 0.02, add: float = 0.02, most: float = 0.2) -> DataFrame:
    """(symbol, bar_id, sar, trend): the parabolic stop that holds for each bar, known at the bar before; it turns when touched.

    The first bar begins an up-trend at its own low."""

    def step(s: dict, b) -> list[tuple]:
        if not s:
            s.update(trend=1, sar=b.low, best=b.high, af=first)
        else:
            s["sar"] += s["af"] * (s["best"] - s["sar"])
            up = s["trend"] > 0
            if (b.low <= s["sar"]) if up else (b.high >= s["sar"]):
                s.update(trend=-s["trend"], sar=s["best"], best=b.low if up else b.high, af=first)
            elif (b.high > s["best"]) if up else (b.low < s["best"]):
                s.update(best=b.high if up else b.low, af=min(most, s["af"] + add))
        return [(b.symbol, b.bar_id, float(s["sar"]), s["trend"])]

    return streamed(bars.select("symbol", "bar_id", "high", "low"), "symbol", "bar_id", "symbol string, bar_id int, sar double, trend int",
        dict, step)


def replay(bars: DataFrame, setups: DataFrame, ttl: int, hold: int, cooldown: int) -> DataFrame:
    """Setups (symbol, bar_id, side, entry, stop, target) replayed bar by bar: a pending limit lives `ttl` bars, one order
    or position at a time, stop before target inside a bar, no target on the bar of the fill, out after `hold` bars,
    then `cooldown` bars of rest. Per trade: setup_id, fill_id, exit_id, side, entry, exit_px, why."""
    j = bars.select("symbol", "bar_id", "high", "low", "close").join(setups.select("symbol", "bar_id", "side", "entry", "stop", "target"),
        ["symbol", "bar_id"], "left")

    def step(s: dict, b) -> list[tuple]:
        out, p = [], s.get("p")
        if p and "fill" in p:
            up = p["side"] > 0
            why, px = None, None
            if (b.low <= p["stop"]) if up else (b.high >= p["stop"]):
                why, px = "stop", p["stop"]
            elif (b.high >= p["target"]) if up else (b.low <= p["target"]):
                why, px = "target", p["target"]
            elif b.bar_id - p["fill"] >= hold:
                why, px = "time", b.close
            if why:
                out.append((b.symbol, p["id"], p["fill"], b.bar_id, p["side"], p["entry"], float(px), why))
                s.update(p=None, rest=cooldown)
                return out
        elif p:
            if (b.low <= p["entry"]) if p["side"] > 0 else (b.high >= p["entry"]):
                p["fill"] = b.bar_id
                if (b.low <= p["stop"]) if p["side"] > 0 else (b.high >= p["stop"]):
                    out.append((b.symbol, p["id"], b.bar_id, b.bar_id, p["side"], p["entry"], float(p["stop"]), "stop"))
                    s.update(p=None, rest=cooldown)
            elif b.bar_id - p["id"] >= ttl:
                s["p"] = None
            return out
        if s.get("rest", 0) > 0:
            s["rest"] -= 1
        elif s.get("p") is None and b.side == b.side and b.side is not None:
            s["p"] = {"id": b.bar_id, "side": int(b.side), "entry": b.entry, "stop": b.stop, "target": b.target}
        return out

    ddl = "symbol string, setup_id int, fill_id int, exit_id int, side int, entry double, exit_px double, why string"
    return streamed(j, "symbol", "bar_id", ddl, dict, step)


def q_table(steps: DataFrame, rate: float = 0.1, discount: float = 0.9, cost: float = 0.0) -> DataFrame:
    """(symbol, state, action, value) of tabular Q-learning over (symbol, bar_id, state, move): action -1, 0 or 1 earns
    action * move less the cost of a change; all actions of a step are updated, as the market doesn't react."""

    def step(s: dict, b) -> list[tuple]:
        q, last = s.setdefault("q", {}), s.get("last")
        if last is not None:
            best = max(q.get((b.state, a), 0.0) for a in (-1, 0, 1))
            for a in (-1, 0, 1):
                now = q.get((last[0], a), 0.0)
                q[last[0], a] = now + rate * (a * last[1] - cost * abs(a) + discount * best - now)
        s["last"] = (b.state, b.move)
        if not b.final:
            return []
        return [(b.symbol, int(k), a, float(v)) for (k, a), v in sorted(q.items())]

    from pyspark.sql import Window

    last = F.max("bar_id").over(Window.partitionBy("symbol"))
    rows = steps.select("symbol", "bar_id", "state", "move").withColumn("final", F.col("bar_id") == last)
    return streamed(rows, "symbol", "bar_id", "symbol string, state int, action int, value double", dict, step)


def mined_masks(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(key, row columns, rule) for every row and rule whose terms all hold; a rule is text such as "z>q0.7 & vr<=q0.4",
    its thresholds exact quantiles of the feature within the key, found in one pass a feature."""
    import re

    terms = {name: [re.fullmatch(r"\s*(\w+)\s*(<=|>=|<|>)\s*q([0-9.]+)\s*", t).groups() for t in text.split("&")] for name,
        text in rules.items()}
    wanted: dict[str, set[str]] = {}
    for parts in terms.values():
        for feature, _, q in parts:
            wanted.setdefault(feature, set()).add(q)
    out = rows
    for feature, qs in wanted.items():
        out = out.join(quantiles(rows, key, feature, {f"_{feature}_{q.replace('.', '_')}": float(q) for q in qs}), key)
    compare = {"<=": Column.__le__, ">=": Column.__ge__, "<": Column.__lt__, ">": Column.__gt__}
    hits = []
    for name, parts in terms.items():
        on = F.lit(True)
        for feature, op, q in parts:
            on = on & compare[op](F.col(feature), F.col(f"_{feature}_{q.replace('.', '_')}"))
        hits.append(F.when(on, F.lit(name)))
    return out.withColumn("rule", F.explode(F.array_compact(F.array(*hits)))).select(*rows.columns, "rule")


def cross_market(bars: DataFrame, partners: dict[str, str], n: int, far: float, near: float) -> DataFrame:
    """Bars whose partner has moved by more than `far` mean ranges over n bars while the symbol moved less than `near`: side is
    the partner's direction. One equal join on the bar's time."""
    w = W.by_symbol()
    mean = F.avg(F.col("high") - F.col("low")).over(W.last_n(20))
    b = bars.select("symbol", "bar_id", "ts", ((F.col("close") - F.lag("close", n).over(w)) / F.nullif(mean, F.lit(0.0))).alias("move"))
    pairs = F.create_map(*(F.lit(x) for kv in partners.items() for x in kv))
    mine = b.withColumn("partner", F.try_element_at(pairs, F.col("symbol"))).where("partner IS NOT NULL")
    other = b.select(F.col("symbol").alias("partner"), "ts", F.col("move").alias("partner_move"))
    j = mine.join(other, ["partner", "ts"]).where((F.abs("partner_move") > far) & (F.abs("move") < near))
    return j.select("symbol", "bar_id", "partner", F.signum("partner_move").cast("int").alias("side"))


def half_levels(bars: DataFrame, k: int) -> DataFrame:
    """Touches of the middle between the last known swing high and low, in the direction of the averages of 20 and 60 bars:
    (symbol, bar_id, side, level)."""
    b = W.fractals(bars, k)
    level, fast, slow = (F.col("last_high") + F.col("last_low")) / 2, W.sma("close", 20), W.sma("close", 60)
    b = b.withColumns({"level": level, "_f": fast, "_s": slow})
    touch = (F.col("low") <= F.col("level")) & (F.col("high") >= F.col("level"))
    side = F.when((F.col("_f") > F.col("_s")) & (F.col("close") > F.col("level")),
        1).when((F.col("_f") < F.col("_s")) & (F.col("close") < F.col("level")), -1)
    return b.withColumn("side", side).where(touch & F.col("side").isNotNull()).select("symbol", "bar_id", "side", "level")


def cointegration(pairs: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Engle-Granger in two steps: x on y, then the Dickey-Fuller t of the residual; p_bound is the least of the usual levels it passes."""
    from pyspark.sql import Window

    fit = pairs.groupBy(key).agg(F.regr_slope(x, y).alias("beta"), F.regr_intercept(x, y).alias("alpha"))
    e = pairs.join(fit, key).withColumn("_e", F.col(x) - F.col("alpha") - F.col("beta") * F.col(y))
    w = Window.partitionBy(key).orderBy(order)
    e = e.withColumn("_p", F.lag("_e").over(w)).withColumn("_d", F.col("_e") - F.col("_p")).where("_p IS NOT NULL AND _d IS NOT NULL")
    sxx, sxy, syy, n = F.regr_sxx("_d", "_p"), F.regr_sxy("_d", "_p"), F.regr_syy("_d", "_p"), F.count("*")
    slope = sxy / sxx
    t = slope / F.sqrt((syy - slope * sxy) / (n - 2) / sxx)
    out = e.groupBy(key).agg(F.first("beta").alias("beta"), n.alias("n"), t.alias("t"))
    # fixed values: critical values of the residual test with two series
    bound = F.when(F.col("t") < -3.90, 0.01).when(F.col("t") < -3.34, 0.05).when(F.col("t") < -3.04, 0.10).otherwise(1.0)
    return out.select(key, F.round("beta", 6).alias("beta"), "n", F.round("t", 6).alias("t"), bound.alias("p_bound"))
