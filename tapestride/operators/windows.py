"""Rolling, recursive and session indicators over bars (symbol, ts, bar_id, open, high, low, close, volume)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def last_n(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(1 - n, 0)


def strict(agg: Column, n: int, of: str = "close") -> Column:
    """The aggregate over n rows, null while there are fewer."""
    w = last_n(n)
    return F.when(F.count(of).over(w) == n, agg.over(w))


def sma(col: str, n: int) -> Column:
    return strict(F.avg(col), n, col)


def zscore(col: str, n: int) -> Column:
    sd = strict(F.stddev_pop(col), n, col)
    return (F.col(col) - sma(col, n)) / F.when(sd > 1e-12, sd)


def bollinger_b(col: str, n: int, k: float) -> Column:
    sd = strict(F.stddev_pop(col), n, col)
    return (F.col(col) - (sma(col, n) - k * sd)) / F.when(sd > 1e-12, 2 * k * sd)


def stochastic_k(n: int) -> Column:
    lo, hi = strict(F.min("low"), n), strict(F.max("high"), n)
    return 100 * (F.col("close") - lo) / F.when(hi > lo, hi - lo)


def williams_r(n: int) -> Column:
    lo, hi = strict(F.min("low"), n), strict(F.max("high"), n)
    return -100 * (hi - F.col("close")) / F.when(hi > lo, hi - lo)


def roc(col: str, n: int) -> Column:
    before = F.lag(col, n).over(by_symbol())
    return (F.col(col) - before) / F.when(before != 0, before)


def true_range() -> Column:
    before = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def cci(bars: DataFrame, n: int, name: str = "cci") -> DataFrame:
    """Adds the CCI whose deviation is the rolling mean of each bar's own |typical price - its average|."""
    b = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = b.withColumn("_ma", strict(F.avg("_tp"), n)).withColumn("_dev", F.abs(F.col("_tp") - F.col("_ma")))
    mean = F.when(F.count("_dev").over(last_n(n)) == n, F.avg("_dev").over(last_n(n)))
    return b.withColumn(name, (F.col("_tp") - F.col("_ma")) / F.when(mean > 1e-12, 0.015 * mean)).drop("_tp", "_ma", "_dev")


def ewm(bars: DataFrame, specs: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds recursive averages y = a*x + (1-a)*y', seeded with the first value: {name: (column, a)}; nulls keep y.

    Inherently ordered: a symbol's bars pass one task in order, batch after batch, and only the averages are carried from
    one batch to the next, so no group is held. One pass for all specs; bars are an aggregate, small beside the tape."""
    from collections.abc import Iterator

    import pandas as pd

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema), *(f"`{n}` double" for n in specs)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = object(), {}
        for pdf in batches:
            parts = []
            for key, own in pdf.groupby("symbol", sort=False, dropna=False):
                if key != symbol and not (pd.isna(key) and symbol is None):
                    symbol, state = None if pd.isna(key) else key, {}
                out = {}
                for n, (c, a) in specs.items():
                    x = own[c].astype(float)
                    before = [state[n]] if n in state else []
                    y = pd.concat([pd.Series(before, dtype=float), x]).ewm(alpha=a, adjust=False,
                        ignore_na=True).mean().to_numpy()[len(before) :]
                    if y[-1] == y[-1]:
                        state[n] = y[-1]
                    out[n] = y
                parts.append(own.assign(**out))
            if parts:
                yield pd.concat(parts)

    return bars.repartition("symbol").sortWithinPartitions("symbol", "bar_id").mapInPandas(run, schema)


def rsi(bars: DataFrame, n: int, more: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Adds rsi (Wilder averages of gains and losses, 50 where there is no loss and no gain), both averages, and those of `more`."""
    d = F.col("close") - F.lag("close").over(by_symbol())
    b = bars.withColumns({"gain": F.coalesce(F.greatest(d, F.lit(0.0)), F.lit(0.0)),
        "loss": F.coalesce(F.greatest(-d, F.lit(0.0)), F.lit(0.0))})
    b = ewm(b, {"avg_gain": ("gain", 1 / n), "avg_loss": ("loss", 1 / n)} | (more or {}))
    return b.withColumn("rsi", F.when(F.col("avg_gain") + F.col("avg_loss") > 0,
        100 * F.col("avg_gain") / (F.col("avg_gain") + F.col("avg_loss"))).otherwise(50.0))


def trailing_time(df: DataFrame, keys: list[str], at: str, seconds: int, cell: int,
    made: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Adds columns over the last `seconds` before each row, itself and equal times included.

    Rows are dealt into time cells and those near a cell's end are copied to the next one, so that no window holds a
    key's whole history; a cell must be longer than the window."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    d = df.withColumn("_t", us).withColumn("_own", F.floor(F.col("_t") / (cell * 1_000_000)))
    late = (F.col("_own") + 1) * (cell * 1_000_000) - F.col("_t") <= seconds * 1_000_000
    d = d.withColumn("_cell", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy(*keys, "_cell").orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    return d.withColumns(made(w)).where("_cell = _own").drop("_t", "_own", "_cell")


def session_vwap(bars: DataFrame) -> DataFrame:
    """Adds day, vwap (running within the day) and vwap_sd: the running deviation from the running vwap, two stages."""
    w = Window.partitionBy("symbol", "day").orderBy("ts")
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.greatest(F.col("volume").cast("double"), F.lit(1.0))
    b = bars.withColumn("day", F.to_date("ts")).withColumn("vwap", F.sum(tp * v).over(w) / F.sum(v).over(w))
    return b.withColumn("vwap_sd", F.sqrt(F.avg(F.pow(tp - F.col("vwap"), 2)).over(w)))


def drawdown(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds equity (running sum), peak and drawdown per key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("equity", F.sum(value).over(w)).withColumn("peak",
        F.greatest(F.max("equity").over(w), F.lit(0.0))).withColumn("drawdown", F.col("equity") - F.col("peak"))


def run_lengths(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Adds run_no and run_pos: islands of an unchanged state."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    d = df.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(w))
    return d.withColumn("run_pos", F.row_number().over(Window.partitionBy(key, "run_no").orderBy(*order))).drop("_new")


def rank_pct(bars: DataFrame, col: str, n: int, name: str) -> DataFrame:
    """Adds the share of the last n values below the current one, ties by half."""
    b = bars.withColumn("_w", F.collect_list(col).over(last_n(n)))
    below, same = F.size(F.filter("_w", lambda x: x < F.col(col))), F.size(F.filter("_w", lambda x: x == F.col(col)))
    return b.withColumn(name, F.when(F.size("_w") == n, (below + (same + 1) / 2) / n)).drop("_w")


def fractals(bars: DataFrame, k: int) -> DataFrame:
    """Adds swing_high and swing_low, known k bars later: the extreme of 2k+1 bars, and the last known ones."""
    w, frame = by_symbol(), by_symbol().rowsBetween(-2 * k, 0)
    full = F.count("*").over(frame) == 2 * k + 1
    hi, lo = F.lag("high", k).over(w), F.lag("low", k).over(w)
    b = bars.withColumns({"swing_high": F.when(full & (hi == F.max("high").over(frame)), hi),
        "swing_low": F.when(full & (lo == F.min("low").over(frame)), lo)})
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumns({"last_high": F.last("swing_high", True).over(up_to), "last_low": F.last("swing_low", True).over(up_to)})


def structure(bars: DataFrame, displacement: float) -> DataFrame:
    """Adds fair-value gaps, order blocks and structure shifts; needs last_high and last_low."""
    w = by_symbol()
    body = F.abs(F.col("close") - F.col("open"))
    avg_body = F.avg(body).over(w.rowsBetween(-20, -1))
    strong = body > displacement * avg_body
    back = w.rowsBetween(-10, -1)
    return bars.withColumns({
        "fvg_up": F.when((F.col("low") > F.lag("high", 2).over(w)) & strong, F.col("low") - F.lag("high", 2).over(w)),
        "fvg_down": F.when((F.col("high") < F.lag("low", 2).over(w)) & strong, F.lag("low", 2).over(w) - F.col("high")),
        "block_up": F.when(strong & (F.col("close") > F.col("open")),
        F.last(F.when(F.col("close") < F.col("open"), F.col("low")), True).over(back)),
        "block_down": F.when(strong & (F.col("close") < F.col("open")),
        F.last(F.when(F.col("close") > F.col("open"), F.col("high")), True).over(back)),
        "shift": F.when((F.col("close") > F.col("last_high")) & (F.lag("close").over(w) <= F.lag("last_high").over(w)),
        1).when((F.col("close") < F.col("last_low")) & (F.lag("close").over(w) >= F.lag("last_low").over(w)), -1).otherwise(0),
        "sweep": F.when((F.col("high") > F.col("last_high")) & (F.col("close") < F.col("last_high")),
        -1).when((F.col("low") < F.col("last_low")) & (F.col("close") > F.col("last_low")), 1).otherwise(0),
    })


def path_stats(bars: DataFrame, n: int) -> DataFrame:
    """Adds efficiency (net move over path), choppiness (range share of the summed true range) and flips (sign changes) of n bars."""
    w, frame = by_symbol(), last_n(n)
    b = bars.withColumn("_s", F.col("close") - F.lag("close").over(w)).withColumn("_tr", true_range())
    b = b.withColumn("_f", F.when(F.signum("_s") * F.signum(F.lag("_s").over(w)) < 0, 1).otherwise(0))
    full, path, spread = F.count("_s").over(frame) == n, F.sum(F.abs("_s")).over(frame), F.max("high").over(frame) - F.min("low").over(frame)
    return b.withColumns({
        "efficiency": F.when(full & (path > 0), F.abs(F.sum("_s").over(frame)) / path),
        "choppiness": F.when(full & (spread > 0), 100 * F.log10(F.sum("_tr").over(frame) / spread) / F.log10(F.lit(n))),
        "flips": F.when(full, F.sum("_f").over(frame)),
    }).drop("_s", "_tr", "_f")


def packed_sequence(bars: DataFrame, n: int) -> DataFrame:
    """Adds code: the last n bar directions (down 0, flat 1, up 2) as a base-3 number."""
    w = by_symbol()
    letter = F.signum(F.col("close") - F.col("open")).cast("int") + 1
    b = bars.withColumn("_l", letter)
    code = sum((F.lag("_l", k).over(w) * 3**k for k in range(1, n)), F.col("_l") * 1)
    return b.withColumn("code", code).drop("_l")


def close_range() -> Column:
    """The true range without the low's distance from the close before; the mean of 14 is another ATR."""
    before = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("close") - before))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Adds macd, its signal line and the histogram."""
    b = ewm(bars, {"_f": ("close", 2 / (fast + 1)), "_s": ("close", 2 / (slow + 1))}).withColumn("macd",
        F.col("_f") - F.col("_s")).drop("_f", "_s")
    return ewm(b, {"macd_signal": ("macd", 2 / (signal + 1))}).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def forms(bars: DataFrame, col: str) -> DataFrame:
    """Adds six questions about a column: z288, changes over 21 and 89 bars, place in the range of 55 and 233 bars, acceleration."""
    w, c = by_symbol(), F.col(col)
    least = lambda agg, n, m: F.when(F.count(col).over(last_n(n)) >= m, agg(col).over(last_n(n)))
    sd = least(F.stddev_samp, 288, 72)
    place = lambda n: (c - least(F.min, n, n // 3)) / F.nullif(least(F.max, n, n // 3) - least(F.min, n, n // 3), F.lit(0.0))
    b = bars.withColumn("_d", c - F.lag(col).over(w))
    return b.withColumns({
        "z288": (c - least(F.avg, 288, 72)) / F.when(sd > 1e-12, sd), "d21": c - F.lag(col, 21).over(w), "d89": c - F.lag(col, 89).over(w),
        "rk55": place(55), "rk233": place(233), "acc": F.col("_d") - F.lag("_d", 21).over(w),
    }).drop("_d")


def unique_fractals(bars: DataFrame, k: int) -> DataFrame:
    """Adds peak and trough: the bar alone has the extreme of the 2k+1 bars around it; known only k bars later."""
    frame = by_symbol().rowsBetween(-k, k)
    full = F.count("*").over(frame) == 2 * k + 1
    b = bars.withColumns({"_h": F.max("high").over(frame), "_l": F.min("low").over(frame), "_hs": F.collect_list("high").over(frame),
        "_ls": F.collect_list("low").over(frame)})
    alone = lambda c, x, xs: full & (F.col(c) == F.col(x)) & (F.size(F.filter(xs, lambda v: v == F.col(x))) == 1)
    return b.withColumns({"peak": alone("high", "_h", "_hs"), "trough": alone("low", "_l", "_ls")}).drop("_h", "_l", "_hs", "_ls")


def open_gaps(bars: DataFrame, life: int) -> DataFrame:
    """Adds gap_floor and gap_ceiling: the nearest three-bar gap below and above that no later bar has filled, of the last `life` bars.

    A gap lives from its bar to the bar that fills it, which a forward window finds; each live gap then meets the bars of
    its life by key, `life` rows at most."""
    w = by_symbol()
    path = F.collect_list(F.struct("low", "high")).over(w.rowsBetween(0, life - 1))
    b = bars.select("symbol", "bar_id", "ts", F.lag("high", 2).over(w).alias("_h2"), F.lag("low", 2).over(w).alias("_l2"), "low", "high",
        path.alias("_p"))
    first = lambda ok: F.coalesce(F.get(F.filter(F.transform("_p", lambda x, i: F.when(ok(x), i)), lambda k: k.isNotNull()), 0),
        F.size("_p"))
    up = F.when(F.col("_h2") < F.col("low"), F.struct(F.lit(True).alias("up"), F.col("_h2").alias("edge"),
        first(lambda x: x["low"] <= F.col("_h2")).alias("n")))
    down = F.when(F.col("_l2") > F.col("high"), F.struct(F.lit(False).alias("up"), F.col("_l2").alias("edge"),
        first(lambda x: x["high"] >= F.col("_l2")).alias("n")))
    g = b.select("symbol", "bar_id", F.explode(F.array_compact(F.array(up, down))).alias("g")).where("g.n > 0")
    g = g.select("symbol", F.explode(F.sequence(F.col("bar_id"), F.col("bar_id") + F.col("g.n") - 1)).alias("bar_id"), "g.up", "g.edge")
    near = g.groupBy("symbol", "bar_id").agg(F.max(F.when(F.col("up"), F.col("edge"))).alias("gap_floor"),
        F.min(F.when(~F.col("up"), F.col("edge"))).alias("gap_ceiling"))
    return bars.join(near, ["symbol", "bar_id"], "left")


def level_sweeps(bars: DataFrame) -> DataFrame:
    """Adds sweeps of the previous day's levels (pdh, pdl) and of the 20 bars before: three bars reach beyond, the close is back."""
    w = by_symbol()
    h3, l3 = strict(F.max("high"), 3), strict(F.min("low"), 3)
    before = w.rowsBetween(-20, -1)
    full = F.count("*").over(before) == 20
    sh, sl = F.when(full, F.max("high").over(before)), F.when(full, F.min("low").over(before))
    c = F.col("close")
    flag = lambda x: F.coalesce(x, F.lit(False))
    return bars.withColumns({
        "sweep_pdh": flag((h3 > F.col("pdh")) & (c < F.col("pdh"))), "sweep_pdl": flag((l3 < F.col("pdl")) & (c > F.col("pdl"))),
        "sweep_high": flag((h3 > sh) & (c < sh)), "sweep_low": flag((l3 < sl) & (c > sl)),
    })


def equal_highs(bars: DataFrame, n: int, share: float) -> DataFrame:
    """Adds equal_highs: how many of the last n highs were within `share` of the symbol's median range of the n-bar high at their time."""
    typical = bars.groupBy("symbol").agg(F.percentile(F.col("high") - F.col("low"), F.lit(0.5)).alias("_m"))
    b = bars.join(typical, "symbol")
    top = strict(F.max("high"), n)
    b = b.withColumn("_e", F.coalesce((top - F.col("high") < share * F.col("_m")).cast("int"), F.lit(0)))
    return b.withColumn("equal_highs", F.when(F.count("*").over(last_n(n)) == n, F.sum("_e").over(last_n(n)))).drop("_m", "_e")
