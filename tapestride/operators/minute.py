"""Fifteen pairs of short-term signals and twelve day patterns over bars, each set in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .sessions import ny_date, ny_minute, regular_vwap
from .signals import emit


def strong_bar(up: bool, share: float = 0.55) -> Column:
    """A bar whose body, in the direction, is more than a share of its range."""
    body = (F.col("close") - F.col("open")) * (1 if up else -1)
    return (body > 0) & (body > share * F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))


def volume_share(n: int) -> Column:
    return F.col("volume") / F.nullif(W.sma("volume", n), F.lit(0.0))


def prepared(bars: DataFrame) -> DataFrame:
    """Bars with what the signals ask for: recursive averages, volume ratios, the regular session's VWAP, New York time."""
    b = bars.withColumn("_tr", F.coalesce(W.true_range(), F.col("high") - F.col("low")))
    b = W.rsi(b, 2, {"e5": ("close", 2 / 6), "e10": ("close", 2 / 11), "e13": ("close", 2 / 14), "e50": ("close", 2 / 51),
        "atr": ("_tr", 1 / 14)})
    b = regular_vwap(b)
    w = W.by_symbol()
    b = b.withColumns({
        "vr20": volume_share(20), "vr30": volume_share(30), "vr60": volume_share(60), "m": ny_minute(F.col("ts")),
        "d": ny_date(F.col("ts")),
        "vw": F.last("vwap", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    return b.drop("_tr", "gain", "loss", "avg_gain", "avg_loss")


def minute_signals(bars: DataFrame, orb: tuple[int, int, int] = (570, 575, 600), move: float = 8.0) -> DataFrame:
    """One row per signal that is on. orb: first minute of the opening range, its end, and the end of its break-outs; move: points of a move to fade.

    The three-bar thrust looks further back than three bars, as its definition shifts masks that are shifted already."""
    w = W.by_symbol()
    lag = lambda c, k=1: F.lag(c, k).over(w)
    was = lambda c, k=1: F.coalesce(lag(c, k), F.lit(False))
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    day = Window.partitionBy("symbol", "d")
    opening = (F.col("m") >= orb[0]) & (F.col("m") < orb[1])
    b = prepared(bars).withColumns({
        "up": F.coalesce(strong_bar(True), F.lit(False)), "down": F.coalesce(strong_bar(False), F.lit(False)),
        "inside": (h < lag("high")) & (lo > lag("low")),
        "orh": F.max(F.when(opening, h)).over(day), "orl": F.min(F.when(opening, lo)).over(day), "rg": h - lo,
        "t_up": (F.col("e5") > F.col("e13")) & (F.col("e13") > F.col("e50")),
        "t_dn": (F.col("e5") < F.col("e13")) & (F.col("e13") < F.col("e50")),
        "hi5": W.strict(F.max("high"), 5, "high"), "lo5": W.strict(F.min("low"), 5, "low"), "hi10": W.strict(F.max("high"), 10, "high"),
        "lo10": W.strict(F.min("low"), 10, "low"),
        "hi20": W.strict(F.max("high"), 20, "high"), "lo20": W.strict(F.min("low"), 20, "low"), "ma20": W.sma("close", 20),
        "sd20": W.strict(F.stddev_pop("close"), 20),
        "above5": W.strict(F.sum((c > F.col("e10")).cast("int")), 5), "below5": W.strict(F.sum((c < F.col("e10")).cast("int")), 5),
        "b1u": (c > o) & (c > lag("close")), "b1d": (c < o) & (c < lag("close")),
    })
    b = b.withColumns({
        "tight": W.strict(F.max("rg"), 5, "rg") < 0.6 * W.sma("rg", 20), "touch_u": lo <= F.col("e5"), "touch_d": h >= F.col("e5"),
        "b2u": was("b1u") & (h > lag("high")) & (lo > lag("low")), "b2d": was("b1d") & (h < lag("high")) & (lo < lag("low")),
        "brk_u": F.coalesce((c > F.col("orh")) & (F.col("m") >= orb[1]) & (F.col("m") < orb[2]), F.lit(False)),
        "brk_d": F.coalesce((c < F.col("orl")) & (F.col("m") >= orb[1]) & (F.col("m") < orb[2]), F.lit(False)),
    })
    upto = day.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumns({
        "b3u": was("b2u") & (h > lag("high")) & (lo > lag("low")), "b3d": was("b2d") & (h < lag("high")) & (lo < lag("low")),
        "had_u": F.coalesce(F.max(F.col("brk_u").cast("int")).over(upto), F.lit(0)) == 1,
        "had_d": F.coalesce(F.max(F.col("brk_d").cast("int")).over(upto), F.lit(0)) == 1,
        "seen": F.row_number().over(w) >= 14,
    })
    # values that need an earlier bar become columns, so that masks are plain expressions
    b = b.withColumns({
        "c3": c - lag("close", 3), "c5": c - lag("close", 5), "rsi1": lag("rsi"), "in1": was("inside"), "h1": lag("high"), "l1": lag("low"),
        "tu1": was("t_up"), "td1": was("t_dn"), "xu1": was("touch_u"), "xd1": was("touch_d"),
        "cw1": lag("close") < lag("vw"), "cx1": lag("close") > lag("vw"), "tg1": was("tight"), "ph5": lag("hi5"), "pl5": lag("lo5"),
        "ph10": lag("hi10"), "pl10": lag("lo10"), "ph20": lag("hi20"), "pl20": lag("lo20"),
        "b2u1": was("b2u"), "b2d1": was("b2d"), "b3u2": was("b3u", 2), "b3d2": was("b3d", 2),
    })
    x = {k: F.col(k) for k in b.columns}
    m = x["m"]
    window = lambda a, z: (m >= a) & (m < z)
    # fixed values: the names of the signals
    pairs = {
        "TICK_REVERT": ((x["c3"] <= -move) & (x["c3"] <= -1.5 * x["atr"]) & x["up"],
        (x["c3"] >= move) & (x["c3"] >= 1.5 * x["atr"]) & x["down"]),
        "VOL_SPIKE": ((x["vr60"] >= 3) & x["up"], (x["vr60"] >= 3) & x["down"]),
        "INSIDE_BREAK": (x["in1"] & (c > x["h1"]) & (x["vr30"] >= 1.5), x["in1"] & (c < x["l1"]) & (x["vr30"] >= 1.5)),
        "RSI2_REV": ((x["rsi1"] < 5) & x["up"], (x["rsi1"] > 95) & x["down"]),
        "ORB5": (x["brk_u"] & ~x["had_u"], x["brk_d"] & ~x["had_d"]),
        "EMA_PULLBACK": (x["tu1"] & x["xu1"] & x["up"], x["td1"] & x["xd1"] & x["down"]),
        "VWAP_CROSS": (x["cw1"] & (c > x["vw"]) & (x["vr30"] >= 1.3) & x["up"], x["cx1"] & (c < x["vw"]) & (x["vr30"] >= 1.3) & x["down"]),
        "RANGE_BREAK": (x["tg1"] & (c > x["ph5"]) & (x["vr30"] >= 1.5), x["tg1"] & (c < x["pl5"]) & (x["vr30"] >= 1.5)),
        "LIQ_GRAB": ((lo < x["pl20"]) & (c > x["pl20"]) & x["up"], (h > x["ph20"]) & (c < x["ph20"]) & x["down"]),
        "POWER_HOUR": (window(900, 955) & (x["above5"] >= 4) & x["up"] & (x["vr30"] >= 1.2),
        window(900, 955) & (x["below5"] >= 4) & x["down"] & (x["vr30"] >= 1.2)),
        "3BAR_THRUST": (x["b1u"] & x["b2u1"] & x["b3u2"], x["b1d"] & x["b2d1"] & x["b3d2"]),
        "MORN_REVERT": (window(570, 630) & (x["c5"] <= -move) & x["up"], window(570, 630) & (x["c5"] >= move) & x["down"]),
        "ATR_FADE": ((c - o <= -2 * x["atr"]) & (x["atr"] > 1.5) & x["seen"], (c - o >= 2 * x["atr"]) & (x["atr"] > 1.5) & x["seen"]),
        "BB_REVERT": ((lo <= x["ma20"] - 2 * x["sd20"]) & (c > x["ma20"] - 2 * x["sd20"]) & x["up"],
        (h >= x["ma20"] + 2 * x["sd20"]) & (c < x["ma20"] + 2 * x["sd20"]) & x["down"]),
        "LUNCH_FADE": (window(720, 780) & (lo <= x["pl10"]) & x["up"], window(720, 780) & (h >= x["ph10"]) & x["down"]),
    }
    return emit(b, {f"HF_{n}_{side}": (s, mask) for n, both in pairs.items() for side, s,
        mask in (("LONG", 1, both[0]), ("SHORT", -1, both[1]))})


def day_patterns(bars: DataFrame, gap: float = 20.0, calm: int = 20) -> DataFrame:
    """Twelve long patterns of the New York day: (symbol, bar_id, pattern).

    gap: points of a gap down; calm: bars of rising closes after the day's low. Levels of the day before are those of the
    previous New York date; a day's low is known at the day's end only, as the pattern after it implies."""
    w = W.by_symbol()
    lag = lambda c, k=1: F.lag(c, k).over(w)
    was = lambda c, k=1: F.coalesce(lag(c, k), F.lit(False))
    o, h, lo, c, m = (F.col(x) for x in ("open", "high", "low", "close", "m"))
    b = regular_vwap(bars).withColumns({"m": ny_minute(F.col("ts")), "d": ny_date(F.col("ts")), "vr": volume_share(20),
        "rg": W.strict(F.avg(h - lo), 14)})
    days = b.groupBy("symbol", "d").agg(F.max("high").alias("dh"), F.min("low").alias("dl"), F.max_by("close", "ts").alias("dc"))
    before = Window.partitionBy("symbol").orderBy("d")
    days = days.select("symbol", "d", F.lag("dh").over(before).alias("pdh"), F.lag("dl").over(before).alias("pdl"),
        F.lag("dc").over(before).alias("pdc"))
    b = b.join(days, ["symbol", "d"])
    day = Window.partitionBy("symbol", "d")
    inside = lambda a, z: (m >= a) & (m < z)
    night, asia = (m >= 1080) | (m < 120), (m >= 1200) | (m < 240)
    first = lambda cond, col, order: F.min_by(F.when(cond, F.col(col)), F.when(cond, order)).over(day)
    body = F.abs(c - o) / F.nullif(h - lo, F.lit(0.0))
    b = b.withColumns({
        "is_open": m == 570, "hl": (lo > lag("low")) & (lag("low") > lag("low", 2)), "thin": F.col("vr") < 0.7,
        "ins": (h < lag("high")) & (lo > lag("low")), "doji": body < 0.2, "body": body,
        "top": F.max("high").over(day.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)),
        "mid_at": first(inside(660, 780), "bar_id", F.struct("low", "bar_id")), "mid_low": F.min(F.when(inside(660, 780), lo)).over(day),
        "night_first": first(night, "close", F.struct("ts")), "night_last": F.max_by(F.when(night, c),
        F.when(night, F.col("ts"))).over(day),
        "lod_at": F.min_by("bar_id", F.struct("low", "bar_id")).over(day), "asia_hi": F.max(F.when(asia, h)).over(day),
        "asia_lo": F.min(F.when(asia, lo)).over(day),
        "touch": F.coalesce((lo <= F.col("vwap")) & (c > F.col("vwap")), F.lit(False)), "over": F.coalesce(c > F.col("pdh"), F.lit(False)),
        "rise": F.coalesce(c >= lag("close"), F.lit(False)),
    })
    b = b.withColumns({
        "thin3": F.col("thin") & was("thin") & was("thin", 2), "ins2": F.col("ins") & was("ins"),
        "doji3": F.col("doji") & was("doji") & was("doji", 2),
        "hl_at": F.min(F.when((F.col("bar_id") > F.col("mid_at")) & (lo > F.col("mid_low")), F.col("bar_id"))).over(day),
        "bull": F.min(F.when(inside(120, 180) & (c > o), F.col("bar_id"))).over(day),
        "touches": F.sum(F.col("touch").cast("int")).over(day.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)),
        "over10": F.max(F.col("over").cast("int")).over(w.rowsBetween(-10, -1)) == 1,
        "rises": F.sum((F.col("rise") & (F.col("bar_id") > F.col("lod_at"))).cast("int")).over(day.orderBy("ts").rowsBetween(1 - calm, 0)),
    })
    b = b.withColumn("hl_high", F.max(F.when(F.col("bar_id") == F.col("hl_at"), h)).over(day))
    b = b.withColumns({
        "rally": F.min(F.when((F.col("bar_id") > F.col("hl_at")) & (c > F.col("hl_high")), F.col("bar_id"))).over(day),
        "hl1": was("hl"), "thin31": was("thin3"), "ins21": was("ins2"), "h2": lag("high", 2), "doji31": was("doji3"),
    })
    x = {k: F.col(k) for k in b.columns}
    at = x["bar_id"]
    # fixed values: the names of the patterns
    masks = {
        "GAP_FILL": x["is_open"] & (o - x["pdc"] <= -gap), "FAILED_BREAKDOWN": (lo < x["pdl"]) & (c > x["pdl"]),
        "THREE_HIGHER_LOWS": x["hl1"] & (c > x["top"]),
        "LIQ_POCKET": x["thin31"] & (x["vr"] >= 1.5) & (c > o), "INSIDE2_BREAK": x["ins21"] & (c > x["h2"]) & (x["vr"] >= 1.2),
        "MIDDAY_LOW": at == x["rally"],
        "OVERNIGHT_DROP": (x["night_last"] - x["night_first"] < -x["rg"]) & (at == x["bull"]),
        "THIRD_VWAP_TOUCH": x["touch"] & (x["touches"] == 3),
        "SINCE_LOW": (at == x["lod_at"] + calm) & (x["rises"] == calm),
        "ASIAN_LOWQ": x["is_open"] & (o <= x["asia_lo"] + 0.25 * (x["asia_hi"] - x["asia_lo"])),
        "PDH_FLIP": x["over10"] & (lo <= x["pdh"]) & (c > x["pdh"]),
        "TRIPLE_DOJI": x["doji31"] & (c > o) & (x["vr"] >= 1.5) & (x["body"] > 0.6),
    }
    return emit(b, {n: (1, mask) for n, mask in masks.items()}).select("symbol", "bar_id", F.col("signal_name").alias("pattern"))


def level_rejections(bars: DataFrame, swings: list[int], recency: list[int], near_bps: list[float]) -> DataFrame:
    """One row per bar, trigger (k, n, prox) and side that rejects the extreme of the confirmed swings known in the last n bars.

    A swing of k bars on either side is known k bars later and stays the last known one until the next."""
    w = W.by_symbol()
    b = bars
    for k in swings:
        b = W.fractals(b, k).withColumnRenamed("last_high", f"_h{k}").withColumnRenamed("last_low", f"_l{k}").drop("swing_high",
            "swing_low")
    h, lo, c = (F.col(x) for x in ("high", "low", "close"))
    half = (h + lo) / 2
    hits = []
    for k in swings:
        for n in recency:
            top, floor = F.max(f"_h{k}").over(w.rowsBetween(1 - n, 0)), F.min(f"_l{k}").over(w.rowsBetween(1 - n, 0))
            b = b.withColumns({f"_t{k}_{n}": top, f"_f{k}_{n}": floor})
            for p in near_bps:
                for side, on in ((-1, (h >= F.col(f"_t{k}_{n}") * (1 - p * 1e-4)) & (c < half)),
                    (1, (lo <= F.col(f"_f{k}_{n}") * (1 + p * 1e-4)) & (c > half))):
                    hits.append(F.when(on, F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(float(p)).alias("prox"),
                        F.lit(side).alias("side"))))
    return b.select("symbol", "bar_id", F.explode(F.array_compact(F.array(*hits))).alias("x")).select("symbol", "bar_id", "x.*")


def impulse_setups(bars: DataFrame, window: int, impulse: float, pullback: float, stop: float, target: float, tick: float,
    invert: bool = False) -> DataFrame:
    """Limit setups after an impulse of the last `window` bars: side, approach (the impulse's own side), entry, stop, target.

    Prices keep to the tick: of a long approach the entry is rounded down, of a short one up, stop and target up. Inverted,
    the trade goes against the impulse, while the entry is still reached from the impulse's side."""
    w = W.last_n(window)
    full = F.count("*").over(w) == window
    b = bars.withColumns({"_hi": F.max("high").over(w), "_lo": F.min("low").over(w),
        "_net": F.when(full, F.col("close") - F.first("open").over(w))})
    b = b.withColumn("approach", F.when(F.col("_net") >= impulse, 1).when(F.col("_net") <= -impulse, -1)).where("approach IS NOT NULL")
    span = (F.col("_hi") - F.col("_lo")) * pullback
    steps = lambda x: F.round(x / tick, 6)
    up = F.col("approach") > 0
    entry = F.when(up, F.floor(steps(F.col("_hi") - span))).otherwise(F.ceil(steps(F.col("_lo") + span))) * tick
    raw = F.when(up, F.col("_hi") - span).otherwise(F.col("_lo") + span)
    b = b.withColumns({"side": F.col("approach") * (-1 if invert else 1), "entry": entry, "_raw": raw})
    base = F.col("entry") if invert else F.col("_raw")
    return b.withColumns({"stop": F.ceil(steps(base - F.col("side") * stop)) * tick,
        "target": F.ceil(steps(base + F.col("side") * target)) * tick}).drop("_hi", "_lo", "_net", "_raw")


def is_reached(approach: Column, entry: Column) -> Column:
    """Whether a bar (high, low) reaches the entry from the side the impulse came from."""
    return F.when(approach > 0, F.col("low") <= entry).otherwise(F.col("high") >= entry)


def bar_families(bars: DataFrame, n: int = 20) -> DataFrame:
    """Families of bar patterns, long and short: (symbol, bar_id, family, side)."""
    w, frame = W.by_symbol(), W.last_n(n)
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    before = w.rowsBetween(-n, -1)
    b = bars.withColumns({
        "ma": F.avg("close").over(frame), "ar": F.avg(h - lo).over(frame), "av": F.avg("volume").over(frame), "po": F.lag("open").over(w),
        "ph": F.lag("high").over(w), "pl": F.lag("low").over(w), "pc": F.lag("close").over(w),
        "p2h": F.lag("high", 2).over(w), "p2l": F.lag("low", 2).over(w), "c3": F.lag("close", 3).over(w), "dop": F.first("open").over(day),
        "h20": F.max("high").over(before), "l20": F.min("low").over(before),
        "lw": F.least(o, c) - lo, "uw": h - F.greatest(o, c), "body": F.abs(c - o), "rg": h - lo,
    })
    x = {k: F.col(k) for k in b.columns}
    ph, pl, pc, po, dop, ar = (x[k] for k in ("ph", "pl", "pc", "po", "dop", "ar"))
    inside = (ph < x["p2h"]) & (pl > x["p2l"])
    outside = (h > ph) & (lo < pl)
    # fixed values: the names of the families
    both = {
        "keltrev": (c < x["ma"] - 1.5 * ar, c > x["ma"] + 1.5 * ar),
        "engulf": ((pc < po) & (c > o) & (c >= po) & (o <= pc), (pc > po) & (c < o) & (c <= po) & (o >= pc)),
        "hammer": ((x["lw"] >= 2 * x["body"]) & (x["uw"] <= x["body"]) & (x["rg"] > 0),
        (x["uw"] >= 2 * x["body"]) & (x["lw"] <= x["body"]) & (x["rg"] > 0)), "insidebrk": (inside & (c > ph), inside & (c < pl)),
        "outsidefade": (outside & (c < o), outside & (c > o)), "dayopenrev": ((lo < dop) & (c > dop) & (pc < dop),
        (h > dop) & (c < dop) & (pc > dop)),
        "wickfade": ((x["lw"] > 0.6 * x["rg"]) & (x["rg"] > ar), (x["uw"] > 0.6 * x["rg"]) & (x["rg"] > ar)),
        "volclimax": ((v > 3 * x["av"]) & (c < o), (v > 3 * x["av"]) & (c > o)),
        "donchian": (c > x["h20"], c < x["l20"]), "momcont": (c - x["c3"] > 1.5 * ar, x["c3"] - c > 1.5 * ar),
    }
    on = emit(b, {f"{n}_{s}": (side, mask) for n, pair in both.items() for s, side, mask in (("L", 1, pair[0]), ("S", -1, pair[1]))})
    return on.select("symbol", "bar_id", F.col("signal_name").alias("family"), "side")


def indicator_families(bars: DataFrame) -> DataFrame:
    """Families of signals from indicators and levels, long and short: (symbol, bar_id, family, side); one recursive pass, then windows."""
    from .joins import previous_day

    w = W.by_symbol()
    lag = lambda c, k=1: F.lag(c, k).over(w)
    b = W.rsi(bars, 14, {"fast": ("close", 2 / 13), "slow": ("close", 2 / 27)}).withColumn("macd", F.col("fast") - F.col("slow"))
    b = W.ewm(b, {"line": ("macd", 0.2)}).drop("gain", "loss", "avg_gain", "avg_loss")
    b = W.cci(W.session_vwap(previous_day(b).drop("day")), 20)
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    day = Window.partitionBy("symbol", "day")
    run = day.orderBy("ts")
    sd = W.strict(F.stddev_pop("close"), 20)
    slot = Window.partitionBy("symbol", F.hour("ts"), F.minute("ts")).orderBy("ts")
    b = b.withColumns({
        "ma20": W.sma("close", 20), "ma60": W.sma("close", 60), "ma120": W.sma("close", 120), "sd": sd, "k": W.stochastic_k(14),
        "ar": W.strict(F.avg(h - lo), 20), "top": F.max("high").over(w.rowsBetween(-20, -1)), "floor": F.min("low").over(w.rowsBetween(-20, -1)),
        "clv": (c - lo) / F.nullif(h - lo, F.lit(0.0)), "m": ny_minute(F.col("ts")), "nth": F.row_number().over(run),
        "same": F.lag(c - o).over(slot), "up1": F.coalesce((c > lag("close")).cast("int"), F.lit(0)),
        "dn1": F.coalesce((c < lag("close")).cast("int"), F.lit(0)),
    })
    b = b.withColumns({
        "width": 4 * F.col("sd") / F.nullif("ma20", F.lit(0.0)), "hour_high": F.max(F.when((F.col("m") >= 570) & (F.col("m") < 630), h)).over(run),
        "hour_low": F.min(F.when((F.col("m") >= 570) & (F.col("m") < 630), lo)).over(run), "ups": F.sum("up1").over(W.last_n(5)),
        "downs": F.sum("dn1").over(W.last_n(5)), "pv": F.lag("vwap").over(run),
    })
    at100 = W.last_n(100)
    b = b.withColumns({
        "tight": F.when(F.count("width").over(at100) == 100, F.percentile("width", F.lit(0.25)).over(at100)),
        **{f"p_{x}": lag(x) for x in ("macd", "line", "k", "cci", "close", "clv")}, "p2_clv": lag("clv", 2), "c10": lag("close", 10), "rsi10": lag("rsi", 10),
    })
    x = {k: F.col(k) for k in b.columns}
    band = 2 * x["sd"]
    # fixed values: the names of the families
    both = {
        "rsirev": ((x["rsi"] < 30) & (c > o), (x["rsi"] > 70) & (c < o)), "bollbrk": (c > x["ma20"] + band, c < x["ma20"] - band),
        "squeeze": ((x["width"] <= x["tight"]) & (c > x["top"]), (x["width"] <= x["tight"]) & (c < x["floor"])),
        "macdx": ((x["macd"] > x["line"]) & (x["p_macd"] <= x["p_line"]), (x["macd"] < x["line"]) & (x["p_macd"] >= x["p_line"])),
        "stochx": ((x["k"] > 20) & (x["p_k"] <= 20), (x["k"] < 80) & (x["p_k"] >= 80)),
        "cciext": ((x["p_cci"] < -100) & (x["cci"] > x["p_cci"]), (x["p_cci"] > 100) & (x["cci"] < x["p_cci"])),
        "pdhbrk": ((c > x["pdh"]) & (x["p_close"] <= x["pdh"]), (c < x["pdl"]) & (x["p_close"] >= x["pdl"])),
        "pdhfade": ((lo < x["pdl"]) & (c > x["pdl"]), (h > x["pdh"]) & (c < x["pdh"])), "pivfade": ((lo <= x["s1"]) & (c > x["s1"]), (h >= x["r1"]) & (c < x["r1"])),
        "mapull": ((x["ma20"] > x["ma60"]) & (lo <= x["ma20"]) & (c > x["ma20"]), (x["ma20"] < x["ma60"]) & (h >= x["ma20"]) & (c < x["ma20"])),
        "htfalign": ((c > x["ma20"]) & (x["ma20"] > x["ma60"]) & (x["ma60"] > x["ma120"]), (c < x["ma20"]) & (x["ma20"] < x["ma60"]) & (x["ma60"] < x["ma120"])),
        "clvper": ((x["clv"] > 0.8) & (x["p_clv"] > 0.8) & (x["p2_clv"] > 0.8), (x["clv"] < 0.2) & (x["p_clv"] < 0.2) & (x["p2_clv"] < 0.2)),
        "firsthr": ((x["m"] >= 630) & (x["m"] < 720) & (c > x["hour_high"]), (x["m"] >= 630) & (x["m"] < 720) & (c < x["hour_low"])),
        "todmom": (x["same"] > 0, x["same"] < 0), "gap": ((x["nth"] == 1) & (o > x["pdh"]), (x["nth"] == 1) & (o < x["pdl"])),
        "exhaust": (x["downs"] == 5, x["ups"] == 5), "vwaptrend": ((c > x["vwap"]) & (x["vwap"] > x["pv"]), (c < x["vwap"]) & (x["vwap"] < x["pv"])),
        "vwaprev": (c < x["vwap"] - 1.5 * x["vwap_sd"], c > x["vwap"] + 1.5 * x["vwap_sd"]), "atrexp": ((h - lo > 2 * x["ar"]) & (c > o), (h - lo > 2 * x["ar"]) & (c < o)),
        "rsidiv": ((c < x["c10"]) & (x["rsi"] > x["rsi10"]) & (x["rsi"] < 40), (c > x["c10"]) & (x["rsi"] < x["rsi10"]) & (x["rsi"] > 60)),
    }
    on = emit(b, {f"{n}_{s}": (side, mask) for n, pair in both.items() for s, side, mask in (("L", 1, pair[0]), ("S", -1, pair[1]))})
    return on.select("symbol", "bar_id", F.col("signal_name").alias("family"), "side")
