"""Further window, gate, report and search operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .validate import draw


def oscillators(bars: DataFrame, n: int) -> DataFrame:
    """Adds aroon_up, aroon_down (ties by the latest bar), demarker, cmo and the entropy of the move directions over n bars."""
    w, frame = W.by_symbol(), W.last_n(n)
    up_h, dn_l = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    b = bars.withColumns({"_u": F.greatest(up_h, F.lit(0.0)), "_d": F.greatest(dn_l, F.lit(0.0)),
        "_s": F.col("close") - F.lag("close").over(w)})
    b = b.withColumns({"_g": F.greatest("_s", F.lit(0.0)), "_l": F.greatest(-F.col("_s"), F.lit(0.0))})
    full = F.count("_s").over(frame) == n
    at = lambda c, agg: agg(F.col("bar_id"), c).over(frame)
    hi = at(F.struct("high", "bar_id"), F.max_by)
    lo = at(F.struct(-F.col("low"), F.col("bar_id")), F.max_by)
    g, l, u, d = (F.sum(c).over(frame) for c in ("_g", "_l", "_u", "_d"))
    p = F.sum((F.col("_s") > 0).cast("double")).over(frame) / n
    ent = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(0.0)
    return b.withColumns({
        "aroon_up": F.when(full, 100 * (n - (F.col("bar_id") - hi)) / n),
        "aroon_down": F.when(full, 100 * (n - (F.col("bar_id") - lo)) / n), "demarker": F.when(full & (u + d > 0), u / (u + d)),
        "cmo": F.when(full & (g + l > 0), 100 * (g - l) / (g + l)), "entropy": F.when(full, ent(p) + ent(1 - p)),
    }).drop("_u", "_d", "_s", "_g", "_l")


def next_end_of_day(bars: DataFrame) -> DataFrame:
    """Adds eod_id: the bar_id of the last bar of the day, the next one at or after each bar."""
    w = W.by_symbol()
    last = F.coalesce(F.to_date(F.lead("ts").over(w)) != F.to_date("ts"), F.lit(True))
    b = bars.withColumn("_e", F.when(last, F.col("bar_id")))
    return b.withColumn("eod_id", F.first("_e", True).over(w.rowsBetween(0, Window.unboundedFollowing))).drop("_e")


def adaptive_target(events: DataFrame, key: str, order: str, mfe: str, n: int, least: int) -> DataFrame:
    """Adds target: the median excursion of the n events before, null while fewer than `least`."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    return events.withColumn("target", F.when(F.count(mfe).over(w) >= least, F.percentile(mfe, F.lit(0.5)).over(w)))


def daily_bias(bars: DataFrame) -> DataFrame:
    """Adds bias of the day: the sum of the directions of the three completed daily candles before it; null on the first three days."""
    b = bars.withColumn("day", F.to_date("ts"))
    d = b.groupBy("symbol", "day").agg(F.min_by("open", "ts").alias("o"), F.max_by("close", "ts").alias("c"))
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-3, -1)
    d = d.select("symbol", "day", F.when(F.count("c").over(w) == 3,
        F.sum(F.signum(F.col("c") - F.col("o"))).over(w).cast("int")).alias("bias"))
    return b.join(d, ["symbol", "day"])


def weekly_metrics(results: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Weekly Sharpe and Sortino ratios, profit factor, worst day and week, share of positive weeks, by key."""
    days = results.groupBy(key, F.col(day).alias("day")).agg(F.sum(value).alias("p"))
    weeks = days.groupBy(key, F.date_trunc("week", "day").alias("week")).agg(F.sum("p").alias("p"))
    down = F.sqrt(F.avg(F.pow(F.least("p", F.lit(0.0)), 2)))
    gain, pain = F.sum(F.greatest("p", F.lit(0.0))), -F.sum(F.least("p", F.lit(0.0)))
    sd = F.stddev_samp("p")
    w = weeks.groupBy(key).agg(
        F.count("*").alias("weeks"), F.round(F.avg("p") / F.when(sd > 0, sd) * F.sqrt(F.lit(52.0)), 6).alias("sharpe"),
        F.round(F.avg("p") / F.when(down > 0, down) * F.sqrt(F.lit(52.0)), 6).alias("sortino"),
        F.round(gain / F.when(pain > 0, pain), 6).alias("profit_factor"), F.round(F.min("p"), 4).alias("worst_week"),
        F.round(F.avg((F.col("p") > 0).cast("double")), 6).alias("positive"),
    )
    return w.join(days.groupBy(key).agg(F.round(F.min("p"), 4).alias("worst_day")), key)


def risk_metrics(results: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """By key: ulcer index, worst drawdown, total, recovery, r2 of the equity line over days, worst five days, share of
    winning days, payoff, worst month, and the median, best and spread of weeks."""
    days = results.groupBy(key, F.col(day).alias("day")).agg(F.sum(value).alias("p"))
    w = Window.partitionBy(key).orderBy("day")
    run, five = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-4, 0)
    d = days.withColumns({"e": F.sum("p").over(run), "i": F.row_number().over(w),
        "roll": F.when(F.count("*").over(five) == 5, F.sum("p").over(five))})
    d = d.withColumn("dd", F.col("e") - F.greatest(F.lit(0.0), F.max("e").over(run)))
    win, lose = F.avg(F.when(F.col("p") > 0, F.col("p"))), -F.avg(F.when(F.col("p") < 0, F.col("p")))
    rounded = lambda c, n, k=4: F.round(c, k).alias(n)
    ulcer, mdd, total = F.sqrt(F.avg(F.col("dd") * F.col("dd"))), F.min("dd"), F.max_by("e", "day")
    a = d.groupBy(key).agg(
        rounded(ulcer, "ulcer"), rounded(mdd, "max_drawdown"), rounded(total, "total"),
            rounded(total / F.nullif(-mdd, F.lit(0.0)), "recovery", 6), rounded(total / F.nullif(ulcer, F.lit(0.0)), "ulcer_ratio", 6),
        rounded(F.regr_r2("e", "i"), "r2", 6), rounded(F.min("roll"), "worst_five_days"),
            rounded(F.avg((F.col("p") > 0).cast("double")), "up_days", 6), rounded(win / F.nullif(lose, F.lit(0.0)), "payoff", 6),
    )
    months = days.groupBy(key, F.date_trunc("month", "day")).agg(F.sum("p").alias("m")).groupBy(key).agg(rounded(F.min("m"), "worst_month"))
    weeks = days.groupBy(key, F.date_trunc("week", "day")).agg(F.sum("p").alias("x")).groupBy(key).agg(rounded(F.percentile("x",
        F.lit(0.5)), "median_week"), rounded(F.max("x"), "best_week"), rounded(F.stddev_samp("x"), "sd_week"))
    return a.join(months, key).join(weeks, key)


def leaderboard(results: DataFrame, config: list[str], family: str, score: str, per_family: int) -> DataFrame:
    """The best row of each configuration, then the best of each family (a top-k report); ties by configuration."""
    one = Window.partitionBy(*config).orderBy(F.desc(score))
    fam = Window.partitionBy(family).orderBy(F.desc(score), *config)
    best = results.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(fam)).where(F.col("rank") <= per_family)


def random_control(events: DataFrame, bars: DataFrame, key: str, bar: str, value: str, draws: int) -> DataFrame:
    """Mean value of events beside that of as many bars drawn at random, `draws` times: (key, n, real_mean, control_mean)."""
    n = bars.groupBy(key).agg(F.max(bar).alias("_n"))
    real = events.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("real"))
    e = events.select(key, bar).join(n, key).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    at = (F.floor(draw(F.lit("control"), F.col("d").cast("string"), F.col(bar).cast("string")) * F.col("_n")) + 1).cast("int")
    c = e.select(key, at.alias(bar)).join(bars.select(key, bar, value), [key, bar]).groupBy(key).agg(F.avg(value).alias("control"))
    return real.join(c, key).select(key, "n", F.round("real", 6).alias("real_mean"), F.round("control", 6).alias("control_mean"))


def leave_one_out(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of value over all other keys: from sums, without reading the rows again; keys are few."""
    s = df.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    w = Window.partitionBy()
    return s.select(key, F.round(F.col("s") / F.col("n"), 6).alias("own_mean"),
        F.round((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n")), 6).alias("others_mean"))


def ablation(df: DataFrame, checks: list[str], value: str) -> DataFrame:
    """Mean of value with all checks, and with each one left out: one row of conditional sums, then unpivoted."""
    every = {"none": checks} | {c: [x for x in checks if x != c] for c in checks}
    ok = {k: sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in on), F.lit(0)) == len(on) for k, on in every.items()}
    one = df.agg(*(F.struct(F.count_if(c).alias("n"), F.round(F.avg(F.when(c, F.col(value))), 6).alias("mean_value")).alias(k) for k,
        c in ok.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("without"), F.col(k)["n"].alias("n"),
        F.col(k)["mean_value"].alias("mean_value")) for k in every))
    return one.select(F.inline(rows))


def latin_hypercube(spark, n: int, dims: dict[str, tuple[float, float]], seed: str = "lhs") -> DataFrame:
    """n points, each dimension's n strata used once: a permutation per dimension by hash order; n is a parameter."""
    df = spark.range(1, n + 1).withColumnRenamed("id", "point")
    for name, (lo, hi) in dims.items():
        w = Window.partitionBy().orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit(name), F.col("point").cast("string"))))
        df = df.withColumn(name, F.round(lo + (hi - lo) * (F.row_number().over(w) - 0.5) / n, 6))
    return df


def random_points(bounds: dict[str, tuple[float, float]], n: int, seed: str):
    """Array of n structs (cfg from 1, each parameter drawn between its bounds); explode it beside what the parameters are tried on."""
    at = lambda name, lo, hi, k: F.round(lo + (hi - lo) * draw(F.lit(seed), F.lit(name), F.lit(str(k))), 4).alias(name)
    return F.array(*(F.struct(F.lit(k).alias("cfg"), *(at(name, lo, hi, k) for name, (lo, hi) in bounds.items())) for k in range(1, n + 1)))


def largest_overlap(spans: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query (symbol, q, a, b) the contract whose days (symbol, contract, start, end) overlap it most; ties by name.

    Both sides are dealt into the months they touch, so a query meets only contracts of its own time."""
    months = lambda x, y: F.explode(F.sequence(F.trunc(x, "month"), F.trunc(y, "month"), F.expr("INTERVAL 1 MONTH"))).alias("_m")
    s = spans.where("start <= end").select("symbol", "contract", "start", "end", months("start", "end"))
    j = queries.where("a <= b").select("symbol", "q", "a", "b", months("a", "b")).join(s,
        ["symbol", "_m"]).where("start <= b AND end >= a").drop("_m").distinct()
    days = F.datediff(F.least("end", "b"), F.greatest("start", "a")) + 1
    return j.groupBy("symbol", "q").agg(F.min_by(F.struct("contract", days.alias("days")),
        F.struct(-days, F.col("contract"))).alias("x")).select("symbol", "q", "x.*")


def facing_pivots(bars: DataFrame, k: int, back: int, most: int) -> DataFrame:
    """Adds pivots: for each bar the nearest prior swing levels that face a trade in its direction, at most `most` of them.

    A swing of k bars on either side is known k bars later; one that was known in the last `back` bars faces a long from
    above the close, a short from below it. Candidates are a window's own array, so no bar is joined to others."""
    b = W.fractals(bars, k)
    frame = W.by_symbol().rowsBetween(-back, 0)
    seen = F.collect_list(F.when(F.col("swing_high").isNotNull() | F.col("swing_low").isNotNull(),
        F.struct("bar_id", "swing_high", "swing_low"))).over(frame)
    up = F.col("close") >= F.col("open")
    level = lambda x: F.when(up, x["swing_high"]).otherwise(x["swing_low"])
    ahead = lambda x: F.when(up, x["swing_high"] > F.col("close")).otherwise(x["swing_low"] < F.col("close"))
    near = F.filter(F.reverse(seen), lambda x: F.coalesce(ahead(x), F.lit(False)))
    return b.withColumn("pivots", F.transform(F.slice(near, 1, most), level)).drop("swing_high", "swing_low", "last_high", "last_low")


#: Windows of a symbol that are compared with each other at a time, and cells of the histogram of squared distances.
MOTIF_BLOCK, MOTIF_CELLS = 1024, 4096


def motif_distance(bars: DataFrame, m: int, share: float = 0.02) -> DataFrame:
    """Adds motif and density of a bar's last m closes, z-normalised, among all windows of its symbol that don't overlap them.

    motif: the least distance to an earlier window. density: how many windows, earlier or later, are nearer than the
    `share` quantile of the symbol's squared distances, rounded up to 4 * m / MOTIF_CELLS. Flat and short windows have
    neither. A symbol's windows are cut into blocks and each pair of blocks is one group: a window travels once per
    block, and no pair of windows becomes a row; a pass takes the quantile, a second one distances and counts."""
    b = bars.withColumn("_w", F.collect_list("close").over(W.last_n(m)))
    mean = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x) / m
    b = b.withColumn("_m", mean)
    b = b.withColumn("_sd", F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / m))
    z = F.when((F.size("_w") == m) & (F.col("_sd") > 1e-9), F.transform("_w", lambda x: (x - F.col("_m")) / F.col("_sd")))
    b = b.withColumns({"_z": z, "_k": F.row_number().over(W.by_symbol()).cast("long")}).drop("_w", "_m", "_sd")
    own = F.floor(F.col("_k") / MOTIF_BLOCK)
    dealt = b.where("_z IS NOT NULL").select("symbol", "_k", "_z", own.alias("_own"),
        F.max(own).over(Window.partitionBy("symbol")).alias("_last"))
    dealt = dealt.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    dealt = dealt.select("symbol", "_k", "_z", F.least("_own", "_to").alias("_lo"), F.greatest("_own", "_to").alias("_hi"),
        (F.col("_own") <= F.col("_to")).alias("_low"))
    cells, width = MOTIF_CELLS, 4 * m / MOTIF_CELLS

    def compared(part):
        """Numbers of the older and the newer block's windows, their squared distances, and which pairs count."""
        import numpy as np

        k = part["_k"].to_numpy()
        z = part["_z"].combine_chunks().flatten().to_numpy().reshape(-1, m)
        low = part["_low"].to_numpy()
        old = np.flatnonzero(low)
        new = old if part["_lo"][0] == part["_hi"][0] else np.flatnonzero(~low)
        d = np.zeros((len(old), len(new)))
        for j in range(m):
            d += (z[old, None, j] - z[None, new, j]) ** 2
        return k[old], k[new], d, k[None, new] - k[old, None] >= m

    def cell(d):
        import numpy as np

        return np.minimum((d / width).astype(np.int64), cells - 1)

    def histogram(part):
        import numpy as np

        _, _, d, ok = compared(part)
        n = np.bincount(cell(d[ok]), minlength=cells)
        at = np.flatnonzero(n)
        return pa.table({"symbol": pa.array([part["symbol"][0].as_py()] * len(at), part.schema.field("symbol").type),
            "_cell": pa.array(at, pa.int64()), "_n": pa.array(n[at], pa.int64())})

    def nearest(part):
        import numpy as np

        old, new, d, ok = compared(part)
        near = ok & (cell(d) <= (part["_cut"][0].as_py() if part["_cut"][0].is_valid else -1))
        least = np.where(ok, d, np.inf).min(axis=0, initial=np.inf)
        k, n = np.concatenate([old, new]), np.concatenate([near.sum(axis=1), near.sum(axis=0)])
        least = np.concatenate([np.full(len(old), np.inf), least])
        return pa.table({"symbol": pa.array([part["symbol"][0].as_py()] * len(k), part.schema.field("symbol").type),
            "_k": pa.array(k, pa.int64()), "_d": pa.array(least, pa.float64()), "_n": pa.array(n, pa.int64())})

    kind = f"symbol {bars.schema['symbol'].dataType.simpleString()}"
    counts = dealt.groupBy("symbol", "_lo", "_hi").applyInArrow(histogram, f"{kind}, _cell bigint, _n bigint").groupBy("symbol",
        "_cell").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy("symbol")
    upto = F.sum("_n").over(w.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    cut = counts.select("symbol", "_cell",
        (upto >= share * F.sum("_n").over(w)).alias("_in")).where("_in").groupBy("symbol").agg(F.min("_cell").alias("_cut"))
    found = dealt.join(cut, "symbol", "left").groupBy("symbol", "_lo", "_hi").applyInArrow(nearest,
        f"{kind}, _k bigint, _d double, _n bigint")
    found = found.groupBy("symbol", "_k").agg(F.min("_d").alias("_d"), F.sum("_n").alias("density"))
    motif = F.when(F.col("_d") < float("inf"), F.sqrt("_d"))
    return b.join(found, ["symbol", "_k"], "left").withColumn("motif", motif).drop("_z", "_k", "_d")
