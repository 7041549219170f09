"""Named queries, continued: walks over bars, mined rules, cross-market signals and learners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import minute as Q
from ..operators import sequences as N
from ..operators import windows as W
from ..operators.simulate import first_passage as passage
from .catalog import BARS, CONDS, hourly, masks, query, r
from .catalog3 import spread
from .catalog5 import half_hours


@query(f"""WITH RECURSIVE {BARS}, a AS (SELECT *, CASE WHEN count(*) OVER w = 14 THEN avg(high - low) OVER w END AS atr FROM bars WINDOW w AS (PARTITION BY
 symbol ORDER BY ts ROWS 13 PRECEDING)),
e AS (SELECT symbol, bar_id, atr, atr AS m FROM a WHERE bar_id = 14 UNION ALL SELECT a.symbol, a.bar_id, a.atr,
 e.m + (a.atr - e.m) * 2 / 481.0 FROM e JOIN a ON a.symbol = e.symbol AND a.bar_id = e.bar_id + 1)
SELECT b.symbol, b.bar_id, round(e.atr, 6) AS atr, round(e.m, 6) AS month_mean, coalesce(round(e.atr - e.m, 9) <= 0,
 false) AS calm FROM bars b LEFT JOIN e USING (symbol, bar_id)""")
def atr_regime(spark, sf):
    """The range's mean against its own month-long recursive average, which begins with its first value."""
    b = hourly(spark, sf).withColumn("rg", F.col("high") - F.col("low"))
    b = W.ewm(b.withColumn("atr", W.strict(F.avg("rg"), 14, "rg")), {"m": ("atr", 2 / 481)})
    return b.select("symbol", "bar_id", r("atr").alias("atr"), r("m").alias("month_mean"),
        F.coalesce(F.round(F.col("atr") - F.col("m"), 9) <= 0, F.lit(False)).alias("calm"))


@query(f"""WITH {BARS}, a AS (SELECT ts, close FROM bars WHERE symbol = 'click'), b AS (SELECT ts, close FROM bars WHERE symbol = 'view'),
 j AS (SELECT coalesce(a.ts, b.ts) AS ts, a.close AS x, b.close AS y FROM a FULL JOIN b ON a.ts = b.ts),
f AS (SELECT ts, last_value(x IGNORE NULLS) OVER w AS x, last_value(y IGNORE NULLS) OVER w AS y FROM j WINDOW w AS (ORDER BY ts ROWS UNBOUNDED
 PRECEDING)), g AS (SELECT regr_slope(x, y) AS beta, regr_intercept(x, y) AS alpha FROM f),
e AS (SELECT ts, beta, x - alpha - beta * y AS e FROM f, g), d AS (SELECT beta, lag(e) OVER (ORDER BY ts) AS p,
 e - lag(e) OVER (ORDER BY ts) AS d FROM e),
s AS (SELECT any_value(beta) AS beta, count(*) AS n, regr_sxx(d, p) AS sxx, regr_sxy(d, p) AS sxy, regr_syy(d,
 p) AS syy FROM d WHERE p IS NOT NULL AND d IS NOT NULL), t AS (SELECT beta, n, sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t FROM s)
SELECT 'click-view' AS pair, round(beta, 6) AS beta, n, round(t, 6) AS t, CAST(CASE WHEN t < -3.90 THEN 0.01 WHEN t < -3.34 THEN 0.05 WHEN t < -3.04
 THEN 0.10 ELSE 1.0 END AS DOUBLE) AS p_bound FROM t""")
def cointegration(spark, sf):
    return N.cointegration(spread(spark, sf), "pair", "ts", "x", "y")


PARTNERS = {"click": "view", "view": "click", "purchase": "signup", "signup": "purchase"}


@query(f"""WITH {BARS}, m AS (SELECT symbol, bar_id, ts, (close - lag(close, 3) OVER (PARTITION BY symbol ORDER BY ts)) / nullif(avg(high - low) OVER (PARTITION
 BY symbol ORDER BY ts ROWS 19 PRECEDING), 0) AS mv FROM bars),
p AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in PARTNERS.items())}) t(symbol, partner)) SELECT a.symbol, a.bar_id, p.partner,
 CAST(sign(b.mv) AS INT) AS side FROM m a JOIN p USING (symbol) JOIN m b ON b.symbol = p.partner AND b.ts = a.ts WHERE abs(b.mv) > 1.5 AND abs(a.mv) <
 0.5""")
def cross_market(spark, sf):
    return N.cross_market(hourly(spark, sf), PARTNERS, 3, 1.5, 0.5)


@query(f"""WITH {BARS}, f AS (SELECT *, CASE WHEN count(*) OVER c = 7 AND lag(high, 3) OVER o = max(high) OVER c THEN lag(high, 3) OVER o END AS sh,
 CASE WHEN count(*) OVER c = 7 AND lag(low, 3) OVER o = min(low) OVER c THEN lag(low, 3) OVER o END AS sl,
 CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 END AS a, CASE WHEN count(*) OVER w60 = 60 THEN avg(close) OVER w60 END AS b FROM bars
 WINDOW o AS (PARTITION BY symbol ORDER BY ts), c AS (PARTITION BY symbol ORDER BY ts ROWS 6 PRECEDING),
 w20 AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING)),
l AS (SELECT *, (last_value(sh IGNORE NULLS) OVER u + last_value(sl IGNORE NULLS) OVER u) / 2 AS level FROM f WINDOW u AS (PARTITION BY symbol ORDER
 BY ts ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, CASE WHEN a > b AND close > level THEN 1 WHEN a < b AND close < level THEN -1 END AS side FROM l
 WHERE low <= level AND high >= level)
SELECT symbol, bar_id, side, level FROM s WHERE side IS NOT NULL""")
def half_levels(spark, sf):
    return N.half_levels(hourly(spark, sf), 3)


RULES = {"calm_high": "rg<=q0.4 & cl>q0.7", "wide_low": "rg>q0.6 & cl<q0.3", "busy": "vol>=q0.8"}


@query(f"""WITH {BARS}, f AS (SELECT symbol, bar_id, high - low AS rg, close AS cl, CAST(volume AS DOUBLE) AS vol FROM bars), q AS (SELECT symbol,
 quantile_cont(rg, 0.4) AS r4, quantile_cont(rg, 0.6) AS r6, quantile_cont(cl, 0.7) AS c7, quantile_cont(cl, 0.3) AS c3, quantile_cont(vol,
 0.8) AS v8 FROM f GROUP BY 1), j AS (SELECT * FROM f JOIN q USING (symbol))
SELECT symbol, bar_id, 'calm_high' AS rule FROM j WHERE rg <= r4 AND cl > c7 UNION ALL SELECT symbol, bar_id,
 'wide_low' FROM j WHERE rg > r6 AND cl < c3 UNION ALL SELECT symbol, bar_id, 'busy' FROM j WHERE vol >= v8""")
def mined_rules(spark, sf):
    f = hourly(spark, sf).select("symbol", "bar_id", (F.col("high") - F.col("low")).alias("rg"), F.col("close").alias("cl"),
        F.col("volume").cast("double").alias("vol"))
    return N.mined_masks(f, "symbol", RULES).select("symbol", "bar_id", "rule")


@query(f"""WITH {CONDS}, d AS (SELECT unnest([5.0, 10.0, 20.0]) AS d), j AS (SELECT a.symbol, a.bar_id, CAST(d.d AS DOUBLE) AS d, a.close,
 b.bar_id - a.bar_id AS k, b.high, b.low FROM bars a CROSS JOIN d LEFT JOIN bars b ON a.symbol = b.symbol AND b.bar_id BETWEEN a.bar_id + 1 AND
 a.bar_id + 10),
t AS (SELECT symbol, bar_id, d, min(k) FILTER (WHERE high >= close + d) AS up, min(k) FILTER (WHERE low <= close - d) AS down FROM j GROUP BY 1, 2, 3)
SELECT cond, d, count(*) AS n, count(*) FILTER (WHERE up IS NOT NULL OR down IS NOT NULL) AS resolved, round(avg(CASE WHEN up < coalesce(down,
 99) THEN d WHEN down <= coalesce(up, 99) THEN -d ELSE 0 END), 6) AS mean_result FROM m JOIN t USING (symbol, bar_id) GROUP BY 1, 2""")
def structure_search(spark, sf):
    """Every condition with every distance of the first-passage table, the fall first on a tie."""
    t = passage(hourly(spark, sf), 10, [5.0, 10.0, 20.0])
    m = masks(spark, sf).select("symbol", "bar_id", F.explode("conds").alias("cond"))
    up, down = F.col("tau_up"), F.col("tau_down")
    won = F.when(up < F.coalesce(down, F.lit(99)), F.col("d")).when(down <= F.coalesce(up, F.lit(99)), -F.col("d")).otherwise(0.0)
    return m.join(t, ["symbol", "bar_id"]).groupBy("cond", "d").agg(F.count("*").alias("n"),
        F.count_if(up.isNotNull() | down.isNotNull()).alias("resolved"), r(F.avg(won)).alias("mean_result"))


@query(f"""WITH {BARS}, y AS (SELECT symbol, bar_id, CAST(volume AS DOUBLE) AS x, lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) - close AS f,
 ceil(max(bar_id) OVER (PARTITION BY symbol) / 5.0) AS sz FROM bars), z AS (SELECT *, unnest(range(1, 5)) AS fold FROM y WHERE f IS NOT NULL),
p AS (SELECT symbol, fold, regr_slope(f, x) AS b, regr_intercept(f, x) AS a, count(*) AS n_train FROM z WHERE bar_id <= fold * sz - 4 GROUP BY 1, 2)
SELECT z.symbol, CAST(z.fold AS INT) AS fold, any_value(n_train) AS n_train, count(*) AS n_test, round(any_value(b), 6) AS slope,
 round(sqrt(avg((f - a - b * x) * (f - a - b * x))), 6) AS rmse, round(avg(sign(a + b * x) * f),
 6) AS follow_mean FROM z JOIN p ON p.symbol = z.symbol AND p.fold = z.fold WHERE floor((bar_id - 1) / sz) = z.fold GROUP BY 1, 2""")
def regression_cv(spark, sf):
    """A line fitted before each fold, less the bars whose outcome reaches into it, and judged on the fold."""
    w = W.by_symbol()
    b = hourly(spark, sf).withColumn("sz", F.ceil(F.max("bar_id").over(Window.partitionBy("symbol")) / 5))
    y = b.select("symbol", "bar_id", F.col("volume").cast("double").alias("x"), (F.lead("close", 4).over(w) - F.col("close")).alias("f"),
        "sz").where("f IS NOT NULL")
    z = y.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(4))))
    fit = z.where("bar_id <= fold * sz - 4").groupBy("symbol", "fold").agg(F.regr_slope("f", "x").alias("b"),
        F.regr_intercept("f", "x").alias("a"), F.count("*").alias("n_train"))
    t = z.where("floor((bar_id - 1) / sz) = fold").join(fit, ["symbol", "fold"])
    guess = F.col("a") + F.col("b") * F.col("x")
    miss = F.col("f") - guess
    return t.groupBy("symbol", "fold").agg(F.first("n_train").alias("n_train"), F.count("*").alias("n_test"),
        r(F.first("b")).alias("slope"), r(F.sqrt(F.avg(miss * miss))).alias("rmse"),
        r(F.avg(F.signum(guess) * F.col("f"))).alias("follow_mean"))


@query(f"""WITH RECURSIVE {BARS}, p AS (SELECT symbol, bar_id, 1 AS trend, low AS sar, high AS best,
 CAST(0.02 AS DOUBLE) AS af FROM bars WHERE bar_id = 1 UNION ALL
 SELECT b.symbol, b.bar_id, CASE WHEN CASE WHEN trend > 0 THEN b.low <= sar + af * (best - sar) ELSE b.high >= sar + af * (best - sar) END THEN -trend
 ELSE trend END,
  CASE WHEN CASE WHEN trend > 0 THEN b.low <= sar + af * (best - sar) ELSE b.high >= sar + af * (best - sar) END THEN best ELSE sar + af * (best -
 sar) END,
  CASE WHEN CASE WHEN trend > 0 THEN b.low <= sar + af * (best - sar) ELSE b.high >= sar + af * (best - sar) END THEN CASE WHEN trend > 0 THEN b.low
 ELSE b.high END WHEN trend > 0 THEN greatest(best, b.high) ELSE least(best, b.low) END,
  CASE WHEN CASE WHEN trend > 0 THEN b.low <= sar + af * (best - sar) ELSE b.high >= sar + af * (best - sar) END THEN 0.02 WHEN CASE WHEN trend > 0
 THEN b.high > best ELSE b.low < best END THEN least(0.2, af + 0.02) ELSE af END FROM p JOIN bars b ON b.symbol = p.symbol AND b.bar_id = p.bar_id +
 1)
SELECT symbol, bar_id, round(sar, 6) AS sar, trend FROM p""")
def parabolic_stop(spark, sf):
    return N.parabolic(hourly(spark, sf)).withColumn("sar", r("sar"))


@query()
def setup_replay(spark, sf):
    """Pullback setups replayed bar by bar, one order or position at a time."""
    b = half_hours(spark, sf)
    s = Q.impulse_setups(b, 4, 5.0, 0.618, 12.0, 24.0, 0.25)
    return N.replay(b, s, 6, 20, 2)


@query()
def q_learning(spark, sf):
    """Values of holding short, nothing or long in each state, the state being the last three bars' directions."""
    w = W.by_symbol()
    b = W.packed_sequence(hourly(spark, sf), 3).withColumn("move",
        F.lead("close").over(w) - F.col("close")).where("code IS NOT NULL AND move IS NOT NULL")
    return N.q_table(b.select("symbol", "bar_id", F.col("code").cast("int").alias("state"), "move"), cost=0.25).withColumn("value",
        r("value"))
