"""Grouped statistics beyond the built-in aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlation(x: str, y: str, over=None) -> Column:
    """Pearson correlation of the rows that have both, null where either does not vary (the built-in divides by zero there)."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return at(F.covar_samp(a, b)) / F.nullif(at(F.stddev_samp(a)) * at(F.stddev_samp(b)), F.lit(0.0))


def average_rank(df: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    """Adds the rank of col within keys, ties by their mean."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.rank().over(w.orderBy(col)) + (F.count("*").over(Window.partitionBy(*keys, col)) - 1) / 2)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    d = average_rank(average_rank(df, keys, x, "_x"), keys, y, "_y")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.round(correlation(x, y), 6).alias("pearson"),
        F.round(correlation("_x", "_y"), 6).alias("spearman"))


def quantiles(df: DataFrame, key: str, value: str, probs: dict[str, float], cells: int = 4096) -> DataFrame:
    """Exact quantiles (linear between ranks) of any number of rows a key: a column for each of probs.

    A first pass counts the rows of equal value ranges, so that only the ranges that hold a wanted rank are looked into;
    there values are counted, not listed. No buffer grows with a key's rows. Null values are left out."""
    d = df.select(key, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    span = d.groupBy(key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    d = d.join(span, key)
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / cells).otherwise(1.0)
    d = d.withColumn("_cell", F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(cells - 1)))
    w = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    counts = d.groupBy(key, "_cell").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    counts = counts.withColumn("_to", F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c"))
    ranks = F.array(*(F.struct(F.lit(n).alias("p"), (F.lit(p) * (F.col("_n") - 1)).alias("h")) for n, p in probs.items()))
    held = F.exists(ranks, lambda x: (F.floor(x["h"]) < F.col("_to")) & (F.ceil(x["h"]) >= F.col("_from")))
    found = d.join(counts.where(held).select(key, "_cell", "_from"), [key, "_cell"]).groupBy(key, "_cell",
        "_v").agg(F.count("*").alias("_c"), F.first("_from").alias("_from"), F.first("_n").alias("_n"))
    w = Window.partitionBy(key, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_to", F.col("_from") + F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c"))
    out = []
    for n, p in probs.items():
        h = F.lit(p) * (F.col("_n") - 1)
        at = lambda k: F.max(F.when((k >= F.col("_from")) & (k < F.col("_to")), F.col("_v")))
        lo, hi, part = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
        out.append((lo + (hi - lo) * part).alias(n))
    return found.groupBy(key).agg(*out)


def log_bin(x: Column, steps: int = 4) -> Column:
    """Signed logarithmic bin of a value."""
    return (F.signum(x) * F.floor(steps * F.log1p(F.abs(x)))).cast("int")


def selection_curve(df: DataFrame, score: str, value: str) -> DataFrame:
    """Sketch (bin of score: n, sum of value) and what choosing every bin from here up would give; bins are few."""
    s = df.groupBy(log_bin(F.col(score)).alias("bin")).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return s.select("bin", "n", F.sum("n").over(w).alias("n_from"), F.round(F.sum("s").over(w) / F.sum("n").over(w), 6).alias("mean_from"))


def lag_variance_slope(df: DataFrame, key: str, order: str, col: str, lags: list[int]) -> DataFrame:
    """Hurst exponent: half the slope of ln variance of k-step differences over ln k."""
    w = Window.partitionBy(key).orderBy(order)
    steps = df.select(key, *((F.col(col) - F.lag(col, k).over(w)).alias(f"_{k}") for k in lags))
    d = steps.select(key, F.explode(F.array(*(F.struct(F.lit(k).alias("k"),
        F.col(f"_{k}").alias("d")) for k in lags))).alias("x")).select(key, "x.*")
    v = d.groupBy(key, "k").agg(F.var_pop("d").alias("v")).where("v > 0")
    return v.groupBy(key).agg(F.round(F.regr_slope(F.ln("v"), F.ln("k")) / 2, 6).alias("hurst"))


def overlap(df: DataFrame, item: str, member: str) -> DataFrame:
    """Jaccard overlap of the member sets of all pairs of items that share a member: (a, b, common, jaccard).

    Meant for trade sets of strategies: a member (a bar) holds few items; pairs come from a join on members."""
    s = df.select(item, member).distinct()
    n = s.groupBy(item).agg(F.count("*").alias("n"))
    a, b = s.withColumnRenamed(item, "a"), s.withColumnRenamed(item, "b")
    c = a.join(b, member).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    c = c.join(n.select(F.col(item).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(item).alias("b"), F.col("n").alias("nb")),
        "b")
    return c.select("a", "b", "common", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard"))


def lattice(df: DataFrame, axes: list[str], value: str) -> DataFrame:
    """Every combination of axis values, null meaning any: one cube, on an aggregate of the cells first."""
    cells = df.groupBy(*axes).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    return cells.cube(*axes).agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_value"))
