"""Resampling and validation. Draws come from hashes of (seed, trial, row), so any task can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts' text, equal on every engine."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def permutation_test(df: DataFrame, key: str, value: str, side: str, row: str, trials: int) -> DataFrame:
    """p-value of the mean of value*side against trials where each side is redrawn: (b + 1) / (trials + 1).

    Trials are spread beside the rows and summed with partial aggregation; rows grow by `trials`, a parameter."""
    real = df.groupBy(key).agg(F.avg(F.col(value) * F.col(side)).alias("real"))
    t = df.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    flip = F.when(draw(F.lit("perm"), F.col("trial").cast("string"), F.col(row).cast("string")) < 0.5, -1).otherwise(1)
    null = t.groupBy(key, "trial").agg(F.avg(F.col(value) * F.col(side) * flip).alias("null"))
    b = F.sum((F.col("null") >= F.col("real")).cast("int"))
    return null.join(real, key).groupBy(key).agg(F.round(F.first("real"), 6).alias("real_mean"), b.alias("beaten_by"),
        F.round((b + 1) / (F.count("*") + 1), 6).alias("p_value"))


def poisson_ladder(mean: float = 1.0) -> list[float]:
    """P(count <= k) for k = 0, 1, ... up to the resolution of a draw."""
    from math import exp, factorial

    out, total = [], 0.0
    while total < 1 - 2**-32:
        total += exp(-mean) * mean ** len(out) / factorial(len(out))
        out.append(total)
    return out


POISSON = poisson_ladder()


def bootstrap_mean(df: DataFrame, key: str, value: str, row: str, trials: int) -> DataFrame:
    """5 %, 50 % and 95 % of the mean under Poisson resampling: each row counts as often as its draw says."""
    t = df.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    u = draw(F.lit("boot"), F.col("trial").cast("string"), F.col(row).cast("string"))
    t = t.withColumn("_u", u)
    k = F.coalesce(*(F.when(F.col("_u") < p, n) for n, p in enumerate(POISSON)), F.lit(len(POISSON)))
    m = t.withColumn("_k", k).groupBy(key, "trial").agg((F.sum(F.col(value) * F.col("_k")) / F.sum("_k")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return m.groupBy(key).agg(q.alias("_q")).select(key, *(F.round(F.get("_q", k), 6).alias(n) for k,
        n in enumerate(("p05", "p50", "p95"))))


def walk_forward(df: DataFrame, key: str, order: list[str], value: str, folds: int, train: float) -> DataFrame:
    """Anchored walk-forward: after a first train share, the rest is cut into folds; each fold's mean beside all before it."""
    w = Window.partitionBy(key)
    pos = (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w)
    fold = F.when(pos < train, 0).otherwise(F.floor((pos - train) / (1 - train) * folds) + 1)
    s = df.withColumn("fold", F.least(fold, F.lit(folds))).groupBy(key, "fold").agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    before = Window.partitionBy(key).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return s.select(key, "fold", "n", F.round(F.col("s") / F.col("n"), 6).alias("test_mean"),
        F.round(F.sum("s").over(before) / F.sum("n").over(before), 6).alias("train_mean"),
        F.sum("n").over(before).alias("train_n")).where("fold > 0")


def cpcv(df: DataFrame, key: str, bar: str, value: str, groups: int, purge: int) -> DataFrame:
    """Combinatorial purged cross-validation, two test groups at a time: train rows within `purge` bars of a test group are dropped.

    A row is compared with the combinations, a fixed number, not with other rows."""
    from itertools import combinations

    w = Window.partitionBy(key)
    d = df.withColumn("_n", F.max(bar).over(w)).withColumn("_size", F.ceil(F.col("_n") / groups)).withColumn("_g",
        F.floor((F.col(bar) - 1) / F.col("_size")))
    combos = F.array(*(F.struct(F.lit(f"{a}-{b}").alias("combo"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a,
        b in combinations(range(groups), 2)))
    d = d.withColumn("_c", F.explode(combos))
    near = lambda g: (F.col(bar) > g * F.col("_size") - purge) & (F.col(bar) <= (g + 1) * F.col("_size") + purge)
    test = (F.col("_g") == F.col("_c.a")) | (F.col("_g") == F.col("_c.b"))
    part = F.when(test, "test").when(near(F.col("_c.a")) | near(F.col("_c.b")), "purged").otherwise("train")
    d = d.withColumn("part", part)
    return d.groupBy(key, F.col("_c.combo").alias("combo")).agg(
        F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"),
        F.count_if(F.col("part") == "purged").alias("n_purged"),
        F.round(F.avg(F.when(F.col("part") == "train", F.col(value))), 6).alias("train_mean"),
        F.round(F.avg(F.when(F.col("part") == "test", F.col(value))), 6).alias("test_mean"),
    )


def circular_shift(df: DataFrame, key: str, bar: str, signal: str, value: str, shifts: list[int]) -> DataFrame:
    """Mean of value where the signal, moved by each shift around the key's own length, is on; shift 0 is the real one."""
    n = df.groupBy(key).agg(F.max(bar).alias("_n"))
    on = df.where(F.col(signal)).select(key, bar).join(n, key).withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    on = on.select(key, "shift", (F.pmod(F.col(bar) - 1 + F.col("shift"), F.col("_n")) + 1).alias(bar))
    return on.join(df.select(key, bar, value), [key, bar]).groupBy(key, "shift").agg(F.count(value).alias("n"),
        F.round(F.avg(value), 6).alias("mean_value"))


def week_bootstrap(weeks: DataFrame, key: str, week: str, value: str, trials: int, length: int = 52) -> DataFrame:
    """Years of `length` weeks drawn with replacement from a key's own: 5 % and 50 % of the sum, 5 % of the worst drawdown."""
    n = weeks.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(week))).withColumn("_n",
        F.count("*").over(Window.partitionBy(key)))
    picks = n.groupBy(key).agg(F.first("_n").alias("_n")).withColumn("trial",
        F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(length))))
    at = (F.floor(draw(F.lit("weeks"), F.col("trial").cast("string"), F.col("step").cast("string")) * F.col("_n")) + 1).cast("int")
    y = picks.select(key, "trial", "step", at.alias("_i")).join(n.select(key, "_i", F.col(value).alias("_v")), [key, "_i"])
    w = Window.partitionBy(key, "trial").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    y = y.withColumn("_e", F.sum("_v").over(w))
    y = y.withColumn("_d", F.col("_e") - F.max("_e").over(w)).groupBy(key, "trial").agg(F.sum("_v").alias("year"), F.min("_d").alias("dd"))
    q = lambda c, p, name: F.round(F.percentile(c, F.lit(p)), 4).alias(name)
    return y.groupBy(key).agg(q("year", 0.05, "year_p05"), q("year", 0.5, "year_p50"), q("dd", 0.05, "dd_p05"))


def account_runs(days: DataFrame, key: str, day: str, value: str, trials: int, target: float, loss: float) -> DataFrame:
    """Accounts opened on drawn days: passed at `target`, bust at `loss` below the best so far, else open; counts by key.

    A key's days are one array, folded from each drawn start: an aggregate of the tape, of a few thousand numbers."""
    a = days.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(day, value))).alias("_a"))
    t = a.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    start = F.floor(draw(F.lit("account"), F.col("trial").cast("string")) * F.size("_a")) + 1
    zero = F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("top"), F.lit("open").alias("end"), F.lit(0).alias("n"))

    def step(s, x):
        e = s["e"] + x[value]
        top = F.greatest(s["top"], e)
        end = F.when(e >= target, "passed").when(e <= top - loss, "bust").otherwise("open")
        return F.when(s["end"] != "open", s).otherwise(F.struct(e.alias("e"), top.alias("top"), end.alias("end"), (s["n"] + 1).alias("n")))

    t = t.withColumn("_x", F.aggregate(F.slice("_a", start.cast("int"), F.size("_a")), zero, step))
    return t.groupBy(key, F.col("_x.end").alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("_x.n"), 6).alias("mean_days"))


def verdicts(df: DataFrame, key: str, value: str, split: str, least: int) -> DataFrame:
    """Per key the mean and t of training and holdout rows (split is true for training) and a verdict on the behaviour."""
    t = lambda c: F.avg(c) * F.sqrt(F.count(c)) / F.when(F.stddev_samp(c) > 1e-9, F.stddev_samp(c))
    a, b = F.when(F.col(split), F.col(value)), F.when(~F.col(split), F.col(value))
    s = df.groupBy(key).agg(F.count(a).alias("n_train"), F.count(b).alias("n_hold"), t(a).alias("t_train"), t(b).alias("t_hold"))
    thin = (F.col("n_train") < least) | (F.col("n_hold") < least)
    word = F.when(thin, "thin").when((F.abs("t_train") >= 2) & (F.signum("t_train") == F.signum("t_hold")),
        "holds").when(F.abs("t_train") >= 2, "reverses").otherwise("none")
    return s.select(key, "n_train", "n_hold", F.round("t_train", 6).alias("t_train"), F.round("t_hold", 6).alias("t_hold"),
        word.alias("verdict"))


def contributions(results: DataFrame, name: str, period: str, value: str) -> DataFrame:
    """Weekly Sharpe of the whole book, and of the book without each name; periods without a result count as zero."""
    s = results.groupBy(name, period).agg(F.sum(value).alias("_v"))
    total = s.groupBy(period).agg(F.sum("_v").alias("_t"))
    every = s.select(name).distinct().withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").join(s, [name, period],
        "left")
    rest = F.col("_t") - F.coalesce("_v", F.lit(0.0))
    sharpe = lambda c: F.avg(c) / F.when(F.stddev_samp(c) > 1e-12, F.stddev_samp(c))
    return every.groupBy(name).agg(F.round(sharpe(F.col("_t")), 6).alias("book"), F.round(sharpe(rest), 6).alias("without"),
        F.round(sharpe(F.col("_t")) - sharpe(rest), 6).alias("contribution"))


def expanding_cv(df: DataFrame, key: str, bar: str, value: str, folds: int, embargo: int) -> DataFrame:
    """Expanding walk-forward: each fold is tested on what precedes it, less the last `embargo` bars before it."""
    w = Window.partitionBy(key)
    d = df.withColumn("_size", F.ceil(F.max(bar).over(w) / (folds + 1))).withColumn("_g", F.floor((F.col(bar) - 1) / F.col("_size")))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    train, test = F.col(bar) <= F.col("fold") * F.col("_size") - embargo, F.col("_g") == F.col("fold")
    a, b = F.when(train, F.col(value)), F.when(test, F.col(value))
    return d.groupBy(key, "fold").agg(F.count(a).alias("n_train"), F.count(b).alias("n_test"), F.round(F.avg(a), 6).alias("train_mean"),
        F.round(F.avg(b), 6).alias("test_mean"))
